"""Operators of a training-data pipeline (quality, de-duplication, URL and
toxicity filters, mixing, language, secrets, HTML text, decontamination).

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
