"""DataFrame operators: ranking, sampling, annotation, evaluation, training curves,
events, reports, embedding and models."""
