"""DuckDB SQL for every oracle-checked query.

Written independently of the Spark plans: derived inputs are CTEs over the
registered tables, ranks are plain window functions, pivots are CASE
aggregates.  Only the fixed values (labels, patterns, prompt wording) are
shared with the Spark side, through ``labelforge.spec``.
"""

from __future__ import annotations

from labelforge import spec
from labelforge.functions.text import WHITESPACE
from labelforge.operators import report as rep
from labelforge.sources import views

NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(WHITESPACE)})"


def str_list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def fixed(x: str, d: int) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN printf('%.{d}f', {x}) END)"


TARGETS = spec.TARGET_LABELS
LABEL_NAMES = str_list(TARGETS)

# -- derived inputs -----------------------------------------------------------------

HEAD = f"('Message-ID: <' || CAST(doc_id AS VARCHAR) || '.mail>' || {NL} || 'X-FileName: inbox.nsf' || {NL})"
BODY = f"({HEAD} || {NL} || text)"
RAW_MAIL = f"""raw_mail AS (
  SELECT doc_id, CASE doc_id % 11
    WHEN 0 THEN text
    WHEN 1 THEN {HEAD} || 'skipped line' || {NL} || text
    WHEN 2 THEN ''
    WHEN 3 THEN {BODY} || {NL} || '------------' || {NL} || text
    WHEN 4 THEN {BODY} || {NL} || 'Sent from my phone'
    WHEN 5 THEN {BODY} || {NL} || '--- Forwarded by X ---' || {NL} || text
    WHEN 6 THEN {BODY} || {NL} || {NL} || 'Jane Doe' || {NL} || '01/02/2001 10:11 AM' || {NL} || 'To: b' || {NL} || 'x' || {NL} || 'To: c' || {NL} || text
    WHEN 7 THEN {BODY} || {NL} || {NL} || {NL} || {NL} || 'P.S. ' || text
    WHEN 8 THEN {BODY} || {NL} || 'This message is intended solely for you' || {NL} || text
    WHEN 9 THEN {BODY} || {NL} || 'CONFIDENTIALITY NOTICE ' || text
    ELSE {BODY} END AS message
  FROM documents)"""

POST_VOCAB = str_list(views.POST_VOCABULARY)
POSTS = f"""posts AS (
  SELECT doc_id, text, lang, source,
    CASE WHEN i >= {len(views.POST_VOCABULARY)} THEN upper({POST_VOCAB}[i % {len(views.POST_VOCABULARY)} + 1])
         ELSE {POST_VOCAB}[i % {len(views.POST_VOCABULARY)} + 1] END AS sentiment
  FROM (SELECT *, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS i FROM documents))"""

_REVERSE = spec.target_of_source()
CROSSWALK_CASE = "CASE lower(sentiment) " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in _REVERSE.items()) + " END"
CROSSWALKED = f"""xw AS (
  SELECT doc_id, text, lang, sentiment, {CROSSWALK_CASE} AS emotion, 'crowdflower' AS source
  FROM posts WHERE ({CROSSWALK_CASE}) IS NOT NULL)"""

CLASSES = len(views.VECTOR_LABELS)
CLASS_NAMES = str_list(views.VECTOR_LABELS)
SCORES = """cells AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
cent AS (SELECT label AS c, p, avg(CAST(x AS DOUBLE)) AS v FROM cells GROUP BY label, p),
cnorm AS (SELECT c, sqrt(sum(v * v)) AS cn FROM cent GROUP BY c),
vnorm AS (SELECT vec_id, greatest(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 1e-12) AS vn FROM cells GROUP BY vec_id),
dots AS (SELECT e.vec_id, e.label, k.c, sum(CAST(e.x AS DOUBLE) * k.v) AS dot
         FROM cells e JOIN cent k ON k.p = e.p GROUP BY e.vec_id, e.label, k.c),
scores AS (SELECT d.vec_id, d.label, d.c, d.dot / (v.vn * n.cn) AS cos
           FROM dots d JOIN vnorm v USING (vec_id) JOIN cnorm n USING (c))"""
def _top_label(source: str, name: str, keys: str) -> str:
    """CTE ``name``: the target with the largest of six clamped scores."""
    return f"""{name}_t AS (SELECT {keys}, anger AS "Anger", greatest(joy, love, thankfulness) AS "Joy", sadness AS "Sadness", fear AS "Fear" FROM {source}),
{name} AS (SELECT {keys}, CASE WHEN top <= 0 THEN 'Neutral' WHEN "Anger" = top THEN 'Anger' WHEN "Fear" = top THEN 'Fear'
  WHEN "Joy" = top THEN 'Joy' WHEN "Sadness" = top THEN 'Sadness' END AS emotion
  FROM (SELECT *, greatest("Anger", "Joy", "Sadness", "Fear") AS top FROM {name}_t))"""


TURNS = "turn_scores AS (SELECT conv_id, turn, text, " + ", ".join(
    f"greatest(CAST(0.0 AS DOUBLE), CAST((conv_id * {i + 3} + turn * {i + 1} + coalesce(length(text), 0) * {2 * i + 1}) % 11 - 4 AS DOUBLE)) AS {c}"
    for i, c in enumerate(spec.SCORE_COLUMNS)) + " FROM conversations),\n" + _top_label("turn_scores", "turns", "conv_id, turn, text")

PREDICTIONS = SCORES + """,
predictions AS (
  SELECT vec_id, CAST(label AS INTEGER) AS true_label, CAST(c AS INTEGER) AS pred_label,
    CASE WHEN vec_id % 2 = 0 THEN 'en' ELSE 'de' END AS language
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, c) AS r FROM scores) WHERE r = 1)"""

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
EPOCHS = f"""epochs AS (
  SELECT user_id AS run_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
    value / 2 AS train_loss, CAST({K} % 10 AS DOUBLE) / 10.0 AS train_acc,
    value AS val_loss, CAST({K} AS DOUBLE) / 100.0 AS val_acc, CAST(0.0001 AS DOUBLE) AS learning_rate,
    {K} AS n_samples
  FROM events)"""

RUNS = f"""runs AS (
  SELECT event_id, 'user_' || CAST(user_id AS VARCHAR) AS context_name,
    CASE WHEN event_type = 'error' THEN 'model_load' ELSE 'inference_run' END AS event_type,
    CAST(round(value * 1000000) AS BIGINT) / 1e6 AS duration_seconds, {K} AS num_texts_processed, {K} * 100 AS total_chars_processed,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE value * 13 - value * 3 END AS ram_usage_delta_mb
  FROM events),
derived AS (
  SELECT *,
    CASE WHEN event_type = 'inference_run' AND num_texts_processed > 0
         THEN CAST(total_chars_processed AS DOUBLE) / num_texts_processed END AS avg_chars_per_text,
    CASE WHEN event_type = 'inference_run' AND num_texts_processed > 0 AND duration_seconds > 0
         THEN duration_seconds / num_texts_processed END AS seconds_per_text,
    CASE WHEN event_type = 'inference_run' AND total_chars_processed > 0 AND duration_seconds > 0
         THEN (duration_seconds / total_chars_processed) * 1000 END AS seconds_per_1k_chars
  FROM runs)"""


def _lang_case(mapping: dict) -> str:
    return "CASE lang " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


PERF = f"""perf AS (
  SELECT source AS model_name, {_lang_case(views.DEVICE_BY_LANG)} AS device, lang AS timestamp,
    avg(n_chars) AS sentences_per_second, count(*) AS output_embedding_dim,
    CASE WHEN {_lang_case(views.DEVICE_BY_LANG)} = 'gpu' THEN CAST(max(n_chars) AS DOUBLE) / 10.0 END AS gpu_memory_allocated_mb
  FROM documents GROUP BY source, lang)"""

ACC = f"""acc AS (
  SELECT source AS model_name, {_lang_case(views.DATASET_BY_LANG)} AS dataset,
    CAST(64 AS BIGINT) AS embedding_dimension,
    CASE WHEN count(l.quality) <> 1 THEN count(l.quality) % 7 END AS epoch,
    count(*) % 5 <> 0 AS has_model_info, count(*) % 3 <> 0 AS has_training_metrics, count(l.quality) > 0 AS has_evaluation,
    avg(CASE WHEN d.n_chars > 1000 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END) AS train_acc,
    avg(l.toxic) AS val_acc, avg(l.quality) AS test_acc
  FROM documents d LEFT JOIN labels l USING (doc_id)
  GROUP BY source, lang)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def two_places(x: str) -> str:
    """``x`` rounded to 2 places, as a double."""
    return f"CAST(printf('%.2f', CAST({x} AS DOUBLE)) AS DOUBLE)"


# -- mail cleaning ------------------------------------------------------------------

def _clean_mail_cte() -> str:
    from labelforge.functions.text import unicode_classes
    m = "message"
    he = q("(?s)" + spec.HEADER_END_PATTERN)
    he_test = q("(?s)X-FileName:.*?\\n\\n")
    fallback = q("(?s)^X-FileName:[^\\n]*\\n[^\\n]*\\n(.*)")
    tail = f"substr({m}, strpos({m}, 'X-FileName:'))"
    c1 = (f"CASE WHEN {m} IS NULL THEN '' "
          f"WHEN regexp_matches({m}, {he_test}) THEN {strip(f'regexp_extract({m}, {he}, 1)')} "
          f"WHEN strpos({m}, 'X-FileName:') > 0 AND regexp_matches({tail}, {fallback}) "
          f"THEN {strip(f'regexp_extract({tail}, {fallback}, 1)')} ELSE {m} END")
    fw = q("(?s)" + unicode_classes(spec.FORWARDED_PATTERN))
    mt = q("(?si)" + spec.MULTIPLE_TO_PATTERN)
    rp = q("(?si)" + unicode_classes(spec.REPLIED_PATTERN))
    before = q("(?si)^(.*?)" + unicode_classes(spec.REPLIED_PATTERN))
    c2 = (f"CASE WHEN regexp_matches(c1, {fw}) THEN '' "
          f"WHEN regexp_matches(c1, {mt}) AND regexp_matches(c1, {rp}) "
          f"THEN {strip(f'regexp_extract(c1, {before}, 1)')} ELSE c1 END")
    x = f"regexp_replace(c2, {q('(?s)' + unicode_classes(spec.QUOTED_HEADER_PATTERN))}, '', 'g')"
    for p in spec.FOOTER_PATTERNS:
        x = f"regexp_replace({x}, {q('(?s)' + unicode_classes(p))}, '', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    c3 = f"CASE WHEN c2 = '' THEN '' ELSE {strip(x)} END"
    return f"""cleaned AS (SELECT doc_id, preprocessed_text FROM (
  SELECT doc_id, {c3} AS preprocessed_text FROM (
    SELECT doc_id, {c2} AS c2 FROM (SELECT doc_id, {c1} AS c1 FROM raw_mail)))
WHERE preprocessed_text <> '')"""


def _clean_mail_sql() -> str:
    return with_(RAW_MAIL, _clean_mail_cte()) + "SELECT doc_id, preprocessed_text FROM cleaned"



def _footer_hits_sql() -> str:
    values = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(spec.FOOTER_PATTERNS))
    return (with_(RAW_MAIL) + f"""SELECT p.pattern_id, p.pattern,
  CAST(sum(CASE WHEN regexp_matches(m.message, '(?s)' || p.pattern) THEN 1 ELSE 0 END) AS BIGINT) AS n_hits
FROM raw_mail m CROSS JOIN (VALUES {values}) p(pattern_id, pattern)
GROUP BY p.pattern_id, p.pattern""")


# -- annotation ---------------------------------------------------------------------

def att_ctes(src: str = "documents", key: str = "doc_id") -> str:
    return f"""att0 AS (
  SELECT d.{key} AS email_id, CAST(r.range AS INTEGER) AS attempt_id,
    CAST(('0x' || substr(md5(CAST(d.{key} AS VARCHAR) || '#' || CAST(r.range AS VARCHAR)), 1, 7)) AS BIGINT) AS h
  FROM {src} d CROSS JOIN range(0, {spec.NUM_ATTEMPTS}) r),
att1 AS (
  SELECT email_id, attempt_id,
    CASE WHEN h % 10 <= 6 THEN '{{"emotion": "' || {LABEL_NAMES}[h % {len(TARGETS)} + 1] || '"}}'
         WHEN h % 10 = 7 THEN '{{"emotion": "Surprise"}}'
         WHEN h % 10 = 8 THEN '{{"mood": "Joy"}}'
         ELSE 'no idea' END AS response
  FROM att0),
att AS (
  SELECT email_id, attempt_id,
    CASE WHEN is_object AND list_contains({LABEL_NAMES}, json_extract_string(js, '$.emotion'))
         THEN json_extract_string(js, '$.emotion') ELSE {q(TARGETS[0])} END AS emotion,
    is_object AS success,
    CAST(0.0 AS DOUBLE) AS elapsed_time,
    CASE WHEN is_object THEN response END AS raw_response,
    CASE WHEN js IS NOT NULL THEN NULL ELSE 'answer is not valid JSON' END AS error
  FROM (SELECT *, coalesce(json_type(js) = 'OBJECT', FALSE) AS is_object
        FROM (SELECT *, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS js FROM att1)))"""


ATT = att_ctes()

VOTE = f"""tally AS (
  SELECT email_id, emotion, count(*) AS n, min(attempt_id) AS first_seen FROM att GROUP BY email_id, emotion),
vote AS (
  SELECT t.email_id, t.emotion, CAST(t.n AS DOUBLE) / {float(spec.NUM_ATTEMPTS)} AS confidence, c.emotion_counts
  FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY n DESC, first_seen) AS pos FROM tally) t
  JOIN (SELECT email_id, '{{' || string_agg('"' || emotion || '":' || CAST(n AS VARCHAR), ',' ORDER BY emotion) || '}}'
               AS emotion_counts FROM tally GROUP BY email_id) c USING (email_id)
  WHERE t.pos = 1),
wide AS (
  SELECT email_id, {", ".join(f"max(CASE WHEN attempt_id = {i} THEN emotion END) AS emotion_attempt_{i + 1}" for i in range(spec.NUM_ATTEMPTS))}
  FROM att GROUP BY email_id)"""


def _translated(src: str, key: str, text: str) -> str:
    return f"""tr AS (
  SELECT *,
    CASE WHEN {text} IS NULL OR {strip(text)} = '' THEN {q(spec.EMPTY_TEXT)}
         WHEN {key} % 13 = 0 THEN {q(spec.TRANSLATION_FAILED)}
         ELSE {strip(f"'de:' || {text}")} END AS translated_text,
    CASE WHEN {text} IS NULL OR {strip(text)} = '' THEN TRUE ELSE {key} % 13 <> 0 END AS success,
    CASE WHEN {text} IS NULL OR {strip(text)} = '' THEN ''
         WHEN {key} % 13 = 0 THEN NULL ELSE 'de:' || {text} END AS raw_response,
    CASE WHEN {text} IS NULL OR {strip(text)} = '' THEN NULL
         WHEN {key} % 13 = 0 THEN 'translation service unavailable' END AS error
  FROM {src})"""


# -- evaluation -----------------------------------------------------------------------

def _report_ctes(pred_src: str, k: int, names_sql: str) -> str:
    return f"""p AS (SELECT true_label, pred_label, language AS slice FROM {pred_src}
       UNION ALL SELECT true_label, pred_label, 'all' FROM {pred_src}),
counts AS (SELECT slice, true_label, pred_label, count(*) AS n FROM p GROUP BY ALL),
slices AS (SELECT DISTINCT slice FROM counts),
grid AS (SELECT s.slice, CAST(t.range AS INTEGER) AS true_label, CAST(u.range AS INTEGER) AS pred_label
         FROM slices s CROSS JOIN range({k}) t CROSS JOIN range({k}) u),
long AS (SELECT g.slice, g.true_label, g.pred_label, coalesce(c.n, 0) AS n
         FROM grid g LEFT JOIN counts c ON c.slice = g.slice AND c.true_label = g.true_label AND c.pred_label = g.pred_label),
per AS (SELECT slice, label, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted,
               CAST(sum(tp) AS BIGINT) AS tp
        FROM (SELECT slice, true_label AS label, n AS support, 0 AS predicted,
                     CASE WHEN true_label = pred_label THEN n ELSE 0 END AS tp FROM long
              UNION ALL SELECT slice, pred_label, 0, n, 0 FROM long) GROUP BY slice, label),
rep AS (SELECT slice, CAST(label AS INTEGER) AS label, coalesce({names_sql}[label + 1], 'Label_' || CAST(label AS VARCHAR)) AS class_name,
               coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0) AS precision,
               coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS recall,
               coalesce(CAST(2.0 AS DOUBLE) * tp / nullif(support + predicted, 0), 0.0) AS f1,
               support, tp FROM per),
summ AS (SELECT r.slice,
           CASE WHEN coalesce(o.outside, 0) > 0 THEN 0.0 ELSE coalesce(CAST(sum(r.tp) AS DOUBLE) / nullif(sum(r.support), 0), 0.0) END AS accuracy,
           avg(r.precision) AS macro_precision, avg(r.recall) AS macro_recall, avg(r.f1) AS macro_f1,
           coalesce(sum(r.precision * r.support) / nullif(sum(r.support), 0), 0.0) AS weighted_precision,
           coalesce(sum(r.recall * r.support) / nullif(sum(r.support), 0), 0.0) AS weighted_recall,
           coalesce(sum(r.f1 * r.support) / nullif(sum(r.support), 0), 0.0) AS weighted_f1,
           CAST(sum(r.support) AS BIGINT) AS support
         FROM rep r LEFT JOIN (SELECT slice, sum(CASE WHEN true_label BETWEEN 0 AND {k - 1} AND pred_label BETWEEN 0 AND {k - 1}
                                                      THEN 0 ELSE n END) AS outside FROM counts GROUP BY slice) o
           ON o.slice = r.slice
         GROUP BY r.slice, o.outside)"""


def r9(x: str) -> str:
    return f"round({x}, 9)"


# -- training curves -------------------------------------------------------------------

FLAGGED = """f0 AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min FROM epochs),
f1 AS (SELECT *, val_loss < coalesce(prev_min, CAST('inf' AS DOUBLE)) AS improved FROM f0),
flagged AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS no_improve FROM f1)"""
STOPS = f"""stops AS (SELECT run_id, min(epoch) AS stop_epoch FROM flagged WHERE no_improve >= {spec.PATIENCE} GROUP BY run_id),
ran AS (SELECT f.* FROM flagged f LEFT JOIN stops s USING (run_id) WHERE s.stop_epoch IS NULL OR f.epoch <= s.stop_epoch),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, epoch) AS best_pos,
                  row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS last_pos FROM ran)"""
SUMMARY = f"""summary AS (
  SELECT run_id, count(*) AS epochs_ran, bool_or(no_improve >= {spec.PATIENCE}) AS early_stop_triggered,
    max(CASE WHEN last_pos = 1 THEN train_loss END) AS last_train_loss,
    max(CASE WHEN last_pos = 1 THEN train_acc END) AS last_train_acc,
    max(CASE WHEN last_pos = 1 THEN val_loss END) AS last_val_loss,
    max(CASE WHEN last_pos = 1 THEN val_acc END) AS last_val_acc,
    max(CASE WHEN best_pos = 1 THEN epoch END) AS best_epoch,
    max(CASE WHEN best_pos = 1 THEN val_loss END) AS best_val_loss,
    max(CASE WHEN best_pos = 1 THEN val_acc END) AS best_val_acc
  FROM ranked GROUP BY run_id)"""


# -- comparison --------------------------------------------------------------------------

def _comparison_sql() -> str:
    cpu = views.CPU_DEVICES
    cols = rep.comparison_columns(cpu)
    acc_sel = []
    for kind, stem, suffix in rep.ACC_KINDS:
        for metric, src in (("trainings", "train_acc"), ("val", "val_acc"), ("test", "test_acc")):
            acc_sel.append(f"max(CASE WHEN dataset = {q(kind)} THEN {src} END) AS \"{rep.acc_column(stem, metric, suffix)}\"")
    cpu_sel = ", ".join(f"max(CASE WHEN device = {q(d)} THEN speed END) AS \"Encoding Speed (Sentences/Sec) {d}\""
                        for d in cpu)
    final = ", ".join(
        (f'coalesce(p.model_name, a.model_name) AS "{rep.MODEL}"' if c == rep.MODEL else
         f'coalesce(p.perf_dim, a.acc_dim) AS "{rep.DIMENSION}"' if c == rep.DIMENSION else f'"{c}"')
        for c in cols)
    return with_(PERF, ACC) + f""", pd AS (
  SELECT model_name, device, arg_max_null(sentences_per_second, timestamp) AS speed,
         arg_max_null(gpu_memory_allocated_mb, timestamp) AS mem
  FROM perf GROUP BY model_name, device),
p AS (
  SELECT s.*, d.perf_dim FROM (
    SELECT model_name, max(CASE WHEN device = 'gpu' THEN mem END) AS "{rep.MEMORY}",
           max(CASE WHEN device = 'gpu' THEN speed END) AS "{rep.GPU_SPEED}", {cpu_sel}
    FROM pd GROUP BY model_name) s
  JOIN (SELECT model_name, arg_max_null(output_embedding_dim, timestamp || '|' || device) AS perf_dim
        FROM perf GROUP BY model_name) d USING (model_name)),
files AS (SELECT * FROM acc WHERE has_model_info AND has_training_metrics AND has_evaluation),
a AS (
  SELECT m.model_name, m.acc_dim, x.* EXCLUDE (model_name) FROM
    (SELECT model_name, max(embedding_dimension) AS acc_dim FROM files GROUP BY model_name) m
    LEFT JOIN (SELECT model_name, {", ".join(acc_sel)} FROM files WHERE epoch IS NOT NULL GROUP BY model_name) x
    USING (model_name)),
cmp AS (SELECT {final} FROM p FULL OUTER JOIN a ON p.model_name = a.model_name)
"""


def _comparison_query() -> str:
    cols = rep.comparison_columns(views.CPU_DEVICES)
    doubles = set(cols) - {rep.MODEL, rep.DIMENSION}
    sel = ", ".join(f'round("{c}", 9) AS "{c}"' if c in doubles else f'"{c}"' for c in cols)
    return _comparison_sql() + f"SELECT {sel} FROM cmp"


def _markdown_query() -> str:
    cols = rep.comparison_columns(views.CPU_DEVICES)
    cells = []
    for c in cols:
        if c == rep.MODEL:
            cells.append(f'coalesce("{c}", \'\')')
        elif c == rep.DIMENSION:
            cells.append(f'coalesce(CAST("{c}" AS VARCHAR), \'\')')
        else:
            cells.append(f"coalesce({fixed(chr(34) + c + chr(34), 4)}, '')")
    return _comparison_sql() + (f'SELECT "{rep.MODEL}" AS model_name, '
                                f"'| ' || concat_ws(' | ', {', '.join(cells)}) || ' |' AS markdown_row FROM cmp")


def _incomplete_query() -> str:
    return with_(ACC) + """SELECT model_name, dataset,
  CASE WHEN NOT has_model_info THEN 'missing model_info.json'
       WHEN NOT has_training_metrics THEN 'missing training_metrics.json'
       WHEN NOT has_evaluation THEN 'missing evaluation_results.json'
       WHEN epoch IS NULL THEN 'missing epoch' END AS reason
FROM acc WHERE NOT has_model_info AND (has_training_metrics OR has_evaluation)
  OR has_model_info AND (NOT has_training_metrics OR NOT has_evaluation OR epoch IS NULL)"""


# -- hardware notes ------------------------------------------------------------------------

def _pc_compat_sql() -> str:
    values = ", ".join(f"({q(n)}, CAST({r} AS DOUBLE), CAST({t} AS DOUBLE))" for n, r, t in spec.PC_PROFILES)
    ram_note = (f"'May struggle on ' || profile || ' due to RAM usage (needs ' || {fixed('ram_usage_delta_mb', 2)}"
                f" || 'MB delta, profile target <' || {fixed('max_ram', 2)} || 'MB).'")
    time_note = (f"'May be too slow for ' || profile || ' (takes ' || {fixed('seconds_per_text', 4)}"
                 f" || 's/email, profile target <' || {fixed('max_time', 2)} || 's).'")
    return with_(RUNS) + f""", inf AS (SELECT * FROM derived WHERE event_type = 'inference_run'),
prof AS (SELECT * FROM (VALUES {values}) v(profile, max_ram, max_time)),
ok AS (SELECT i.event_id, i.ram_usage_delta_mb, i.seconds_per_text, p.profile, p.max_ram, p.max_time,
              i.ram_usage_delta_mb <= p.max_ram AS ram_ok, i.seconds_per_text <= p.max_time AS time_ok
       FROM inf i CROSS JOIN prof p
       WHERE i.ram_usage_delta_mb IS NOT NULL AND i.seconds_per_text IS NOT NULL)
SELECT event_id, profile, CASE WHEN ram_ok AND time_ok THEN 'compatible' ELSE 'not compatible' END AS status,
  ram_ok, time_ok,
  CASE WHEN ram_ok AND time_ok THEN 'Likely compatible with: ' || profile
       ELSE concat_ws(' ', CASE WHEN NOT ram_ok THEN {ram_note} END, CASE WHEN NOT time_ok THEN {time_note} END) END AS notes
FROM ok
UNION ALL
SELECT event_id, NULL, 'insufficient data', NULL, NULL, NULL FROM inf
WHERE ram_usage_delta_mb IS NULL OR seconds_per_text IS NULL"""


PREFIX_CASE = ("CASE lang WHEN 'en' THEN " + q(spec.PREFIX_QUERY) + " || text WHEN 'de' THEN "
               + q(spec.PREFIX_PASSAGE) + " || text WHEN 'fr' THEN " + q(spec.instruct_prefix())
               + " || text ELSE text END")
_PROMPT_HEAD, _PROMPT_TAIL = spec.ANNOTATE_USER_PROMPT.split("{text}")
_PROMPT_HEAD = _PROMPT_HEAD.replace("{labels}", ", ".join(TARGETS))

SPLIT = f"""sd AS (SELECT d.doc_id, d.text, d.lang, l.quality, CAST(l.quality AS VARCHAR) || '_' || d.lang AS stratum
       FROM documents d JOIN labels l USING (doc_id)),
sc AS (SELECT stratum, count(*) AS n FROM sd GROUP BY stratum),
st AS (SELECT *, sum(n) OVER () AS big_n FROM sc),
st2 AS (SELECT *, big_n - CAST(ceil(CAST({spec.VAL_SIZE} AS DOUBLE) * big_n) AS BIGINT) AS ntrain FROM st),
st3 AS (SELECT *, (CAST(n AS HUGEINT) * ntrain) // big_n AS fl, (CAST(n AS HUGEINT) * ntrain) % big_n AS rem FROM st2),
st4 AS (SELECT *, ntrain - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, stratum) AS pos FROM st3),
quota AS (SELECT stratum, fl + CASE WHEN pos <= need THEN 1 ELSE 0 END AS n_train FROM st4),
sr AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{spec.SEED}'), doc_id) AS rk
       FROM sd),
split AS (SELECT sr.*, CASE WHEN rk <= n_train THEN 'train' ELSE 'val' END AS split FROM sr JOIN quota USING (stratum))"""

URL_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)?', 1)"
URL_HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)"

FUSED = f"""fused AS (
  SELECT * FROM (
    SELECT CAST(doc_id AS HUGEINT) * 2 AS item_id, text, emotion, source FROM xw
    UNION ALL
    SELECT (CAST(conv_id AS HUGEINT) * 4294967296 + turn) * 2 + 1, text, emotion, 'cbet' FROM turns)
  WHERE emotion IN ({", ".join(q(t) for t in TARGETS)})),
fh AS (SELECT *, md5(CAST(item_id AS VARCHAR) || ':{spec.SEED}') AS hh FROM fused),
fc AS (SELECT emotion, count(*) AS n FROM fh GROUP BY emotion),
bal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY hh, item_id) AS rn FROM fh)
        WHERE rn <= (SELECT min(n) FROM fc)),
en AS (SELECT item_id, text, emotion, source, row_number() OVER (ORDER BY hh, item_id) - 1 AS position FROM bal)"""

POST_DATASET = with_(POSTS, CROSSWALKED, TURNS, FUSED, _translated("en", "item_id", "text")) + """
SELECT CAST(item_id AS VARCHAR) AS item_id, position, emotion, source, 'en' AS language, text AS content FROM tr
UNION ALL SELECT CAST(item_id AS VARCHAR), position, emotion, source, 'de', translated_text FROM tr"""

_ATTEMPT_COLS = ", ".join(f"emotion_attempt_{i + 1}" for i in range(spec.NUM_ATTEMPTS))
MAIL_DATASET = with_(RAW_MAIL, _clean_mail_cte(), """firsts AS (
  SELECT min(doc_id) AS doc_id, preprocessed_text FROM cleaned GROUP BY preprocessed_text),
mails AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS email_id, preprocessed_text FROM firsts)""",
                     att_ctes("mails", "email_id"), VOTE,
                     "labelled AS (SELECT m.email_id, m.preprocessed_text, v.emotion, v.confidence, v.emotion_counts, "
                     + ", ".join(f"w.emotion_attempt_{i + 1}" for i in range(spec.NUM_ATTEMPTS))
                     + " FROM mails m JOIN vote v USING (email_id) JOIN wide w USING (email_id))",
                     _translated("labelled", "email_id", "preprocessed_text")) + f"""
SELECT email_id, emotion, confidence, emotion_counts, {_ATTEMPT_COLS}, 'en' AS language, preprocessed_text AS content FROM tr
UNION ALL SELECT email_id, emotion, confidence, emotion_counts, {_ATTEMPT_COLS}, 'de', translated_text FROM tr"""

# sd (doc_id, stratum, ...) -> split (the same columns and split).
SPLIT_OF_SD = f"""sc AS (SELECT stratum, count(*) AS n FROM sd GROUP BY stratum),
st AS (SELECT *, sum(n) OVER () AS big_n FROM sc),
st2 AS (SELECT *, big_n - CAST(ceil(CAST({spec.VAL_SIZE} AS DOUBLE) * big_n) AS BIGINT) AS ntrain FROM st),
st3 AS (SELECT *, (CAST(n AS HUGEINT) * ntrain) // big_n AS fl, (CAST(n AS HUGEINT) * ntrain) % big_n AS rem FROM st2),
st4 AS (SELECT *, ntrain - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, stratum) AS pos FROM st3),
quota AS (SELECT stratum, fl + CASE WHEN pos <= need THEN 1 ELSE 0 END AS n_train FROM st4),
sr AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{spec.SEED}'), doc_id) AS rk
       FROM sd),
split AS (SELECT sr.*, CASE WHEN rk <= n_train THEN 'train' ELSE 'val' END AS split FROM sr JOIN quota USING (stratum)),
"""

CENTROID_EVAL = f"""WITH sd AS (SELECT vec_id AS doc_id, embedding, label, CAST(label AS VARCHAR) AS stratum FROM embeddings),
{SPLIT_OF_SD}cells AS (SELECT doc_id, label, split, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM split),
cent AS (SELECT label AS c, p, avg(CAST(x AS DOUBLE)) AS v FROM cells WHERE split = 'train' GROUP BY label, p),
cnorm AS (SELECT c, sqrt(sum(v * v)) AS cn FROM cent GROUP BY c),
vnorm AS (SELECT doc_id, greatest(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 1e-12) AS vn
          FROM cells WHERE split = 'val' GROUP BY doc_id),
dots AS (SELECT e.doc_id, e.label, k.c, sum(CAST(e.x AS DOUBLE) * k.v) AS dot
         FROM cells e JOIN cent k ON k.p = e.p WHERE e.split = 'val' GROUP BY e.doc_id, e.label, k.c),
scored AS (SELECT d.doc_id, d.label, d.c, d.dot / (v.vn * n.cn) AS cos
           FROM dots d JOIN vnorm v USING (doc_id) JOIN cnorm n USING (c)),
pred AS (SELECT doc_id, CAST(label AS INTEGER) AS true_label, CAST(c AS INTEGER) AS pred_label, 'x' AS language
         FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, c) AS r FROM scored) WHERE r = 1),
{_report_ctes('pred', 10, str_list([str(i) for i in range(10)]))}
SELECT {", ".join(f"{r9(c)} AS {c}" for c in ["accuracy", "macro_precision", "macro_recall", "macro_f1",
                                               "weighted_precision", "weighted_recall", "weighted_f1"])}, support
FROM summ WHERE slice = 'all'"""

# Signed token counts by the first 32 bits of the token's md5.
def _bucket_ctes(source: str, prefix: str | None) -> str:
    text = "coalesce(text, '')" if prefix is None else f"{q(prefix)} || text"
    return f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM {source}),
h AS (SELECT doc_id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) AS h FROM tok),
bucket AS (SELECT doc_id, h % 64 AS p, CAST(sum(CASE WHEN h < 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM h GROUP BY ALL)"""


EMBED_TEXTS = f"""WITH {_bucket_ctes('documents', spec.PREFIX_QUERY)},
cell AS (SELECT doc_id, p, coalesce(v, 0.0) AS v FROM (SELECT doc_id, unnest(range(64)) AS p FROM documents)
         LEFT JOIN bucket USING (doc_id, p))
SELECT doc_id, CAST(count(*) AS INTEGER) AS dim, round(sqrt(sum(v * v)), 9) AS norm, max(CASE WHEN p = 0 THEN v END) AS first,
  sum(v * (p + 1)) AS placed_sum, CAST(arg_max(p, v * 100 - p) AS INTEGER) AS largest FROM cell GROUP BY doc_id"""


def _matrix_run(line: str) -> str:
    name, normalize, prefix = line.split(";")
    length = "greatest(sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 1e-12)" if normalize == "true" else "1.0"
    return f"""SELECT * FROM (WITH sd AS (SELECT doc_id, text, CAST(quality AS INTEGER) AS label, CAST(quality AS VARCHAR) AS stratum
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
{SPLIT_OF_SD}{_bucket_ctes('split', spec.prefix_for(prefix))},
cells AS (SELECT b.doc_id, label, split, p, v / {length} AS x FROM bucket b JOIN split USING (doc_id)),
cent AS (SELECT c.label AS c, p, sum(x) / any_value(n) AS v FROM cells c
         JOIN (SELECT label, count(*) AS n FROM split WHERE split = 'train' GROUP BY 1) t USING (label)
         WHERE split = 'train' GROUP BY c.label, p),
cnorm AS (SELECT c, sqrt(sum(v * v)) AS cn FROM cent GROUP BY c),
dots AS (SELECT doc_id, c, sum(x * v) AS dot FROM cells JOIN cent USING (p) WHERE split = 'val' GROUP BY ALL),
scored AS (SELECT s.doc_id, s.label, k.c, coalesce(dot, 0.0) / cn AS cos FROM split s CROSS JOIN cnorm k
           LEFT JOIN dots d ON d.doc_id = s.doc_id AND d.c = k.c WHERE split = 'val'),
pred AS (SELECT label AS true_label, c AS pred_label, 'x' AS language
         FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, c) AS r FROM scored) WHERE r = 1),
{_report_ctes('pred', 2, str_list(['low', 'high']))}
SELECT {q(name)} AS model_name, {normalize} AS normalize, {q(prefix)} AS prefix_function, {r9('accuracy')} AS accuracy,
  {r9('macro_f1')} AS macro_f1, {r9('weighted_f1')} AS weighted_f1, support FROM summ WHERE slice = 'all')"""


ORACLE: dict[str, str] = {
    "quality_report": f"""WITH pr AS (
  SELECT CAST(l.quality AS INTEGER) AS true_label, CASE WHEN d.n_chars >= 1500 THEN 1 ELSE 0 END AS pred_label, 'x' AS language
  FROM documents d JOIN labels l USING (doc_id)),
{_report_ctes('pr', 2, "['low', 'high']")}
SELECT label, class_name, {r9('precision')} AS precision, {r9('recall')} AS recall, {r9('f1')} AS f1, support
FROM rep WHERE slice = 'all'""",
    "csv_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "head_n": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "row_ids": "SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents WHERE lang <> 'en'",
    "value_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "counts_by_language": "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source",
    "language_slice": "SELECT doc_id, text, n_chars FROM documents WHERE lang = 'de'",
    "dataset_valid": """SELECT count(*) AS n_rows, coalesce(bool_or(lang = 'en'), FALSE) AS has_en,
  coalesce(bool_or(lang = 'de'), FALSE) AS has_de,
  count(*) > 0 AND coalesce(bool_or(lang = 'en'), FALSE) AND coalesce(bool_or(lang = 'de'), FALSE) AS valid
FROM documents""",
    "dataset_profile": """SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct_texts,
  count(DISTINCT lang) AS n_languages, count(DISTINCT source) AS n_sources,
  string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents""",
    "dedup_first": "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text",
    "balance_classes": f"""WITH h AS (SELECT doc_id, lang, md5(CAST(doc_id AS VARCHAR) || ':{spec.SEED}') AS hh FROM documents),
c AS (SELECT lang, count(*) AS n FROM h GROUP BY lang)
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY hh, doc_id) AS rn FROM h)
WHERE rn <= (SELECT min(n) FROM c)""",
    "shuffle_order": f"""SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{spec.SEED}'), doc_id) - 1
  AS shuffle_rank FROM documents""",
    "stratified_split": with_(SPLIT) + "SELECT doc_id, stratum, split FROM split",
    "split_overlap": with_(SPLIT) + """SELECT v.doc_id, v.lang FROM split v WHERE v.split = 'val'
  AND EXISTS (SELECT 1 FROM split t WHERE t.split = 'train' AND t.text = v.text)""",
    "prefix_text": f"SELECT doc_id, {PREFIX_CASE} AS prefixed_text FROM documents",
    "text_volume": f"""SELECT lang, count(*) AS num_texts, CAST(sum(length(text)) AS BIGINT) AS total_chars,
  {r9('avg(length(text))')} AS avg_chars_per_text FROM documents GROUP BY lang""",
    "email_clean": _clean_mail_sql(),
    "footer_hits": _footer_hits_sql(),
    "label_crosswalk": with_(POSTS, CROSSWALKED) + "SELECT doc_id, sentiment, emotion, source FROM xw",
    "label_encode": with_(POSTS) + f"""SELECT doc_id, label_name,
  CASE label_name {" ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(TARGETS))} END AS emotion_label
FROM (SELECT doc_id, upper(substr(sentiment, 1, 1)) || lower(substr(sentiment, 2)) AS label_name FROM posts)""",
    "fuse_sources": with_(POSTS, CROSSWALKED, TURNS) + f"""SELECT * FROM (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS item_key, text, emotion, source FROM xw
  UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), text, emotion, 'cbet' FROM turns)
WHERE emotion IN ({", ".join(q(t) for t in TARGETS)})""",
    "dominant_label": """WITH s AS (
  SELECT vec_id, """ + ", ".join(
        "greatest(CAST(0.0 AS DOUBLE), list_sum(list_filter(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), "
        f"lambda x, i: (i - 1) % {len(spec.SCORE_COLUMNS)} = {i}))) AS {c}"
        for i, c in enumerate(spec.SCORE_COLUMNS)) + """ FROM embeddings),
""" + _top_label("s", "m", "vec_id") + " SELECT vec_id, emotion FROM m",
    "class_weights": f"""WITH c AS (SELECT label, count(*) AS n_c FROM embeddings GROUP BY 1),
j AS (SELECT CAST(k.range AS INTEGER) AS label, c.n_c FROM range({CLASSES}) k LEFT JOIN c ON c.label = k.range),
w AS (SELECT *, CAST(sum(n_c) OVER () AS DOUBLE) / (CAST({CLASSES} AS DOUBLE) * n_c) AS w FROM j)
SELECT label, coalesce(n_c, 0) AS n_c, {r9('w')} AS weight, {r9(f'pow(w, {spec.CLASS_WEIGHT_ALPHA})')} AS weight_tempered FROM w""",
    "annotate_attempts": with_(ATT) + "SELECT email_id, attempt_id, emotion, success, elapsed_time, raw_response, error FROM att",
    "annotate_validate": with_(ATT) + """SELECT emotion, success, error IS NOT NULL AS has_error, count(*) AS n
FROM att GROUP BY emotion, success, error IS NOT NULL""",
    "vote": with_(ATT, VOTE) + "SELECT email_id, emotion, confidence, emotion_counts FROM vote",
    "vote_wide": with_(ATT, VOTE) + "SELECT * FROM wide",
    "annotate_prompt": f"SELECT doc_id, {q(_PROMPT_HEAD)} || text || {q(_PROMPT_TAIL)} AS prompt FROM documents",
    "prefix_columns": with_(ATT, VOTE) + """SELECT d.doc_id AS email_id, d.text AS content, 'en' AS language,
  v.emotion, v.confidence, v.emotion_counts, """ + ", ".join(
        f"w.emotion_attempt_{i + 1}" for i in range(spec.NUM_ATTEMPTS)) + """
FROM documents d JOIN vote v ON v.email_id = d.doc_id JOIN wide w ON w.email_id = d.doc_id""",
    "translate_status": with_(_translated("documents", "doc_id", "text"))
    + "SELECT doc_id, translated_text, success, raw_response, error FROM tr",
    "combine_languages": with_(POSTS, CROSSWALKED, _translated("xw", "doc_id", "text")) + """
SELECT doc_id, 'en' AS language, text AS content, emotion, source FROM tr
UNION ALL SELECT doc_id, 'de', translated_text, emotion, source FROM tr""",
    "confusion_long": with_(PREDICTIONS) + f""", counts AS (SELECT true_label, pred_label, count(*) AS n FROM predictions GROUP BY ALL)
SELECT CAST(t.range AS INTEGER) AS true_label, CAST(u.range AS INTEGER) AS pred_label,
  {CLASS_NAMES}[t.range + 1] AS true_name, {CLASS_NAMES}[u.range + 1] AS pred_name, coalesce(c.n, 0) AS n
FROM range({CLASSES}) t CROSS JOIN range({CLASSES}) u
LEFT JOIN counts c ON c.true_label = t.range AND c.pred_label = u.range""",
    "confusion_matrix": with_(PREDICTIONS) + f""", counts AS (SELECT true_label, pred_label, count(*) AS n FROM predictions GROUP BY ALL)
SELECT CAST(t.range AS INTEGER) AS true_label, {CLASS_NAMES}[t.range + 1] AS true_name, """ + ", ".join(
        f"coalesce(max(CASE WHEN c.pred_label = {i} THEN c.n END), 0) AS \"{n}\"" for i, n in enumerate(views.VECTOR_LABELS)) + f"""
FROM range({CLASSES}) t LEFT JOIN counts c ON c.true_label = t.range GROUP BY t.range""",
    "class_report": with_(PREDICTIONS) + ", " + _report_ctes("predictions", CLASSES, CLASS_NAMES)
    + f"\nSELECT slice, label, class_name, {r9('precision')} AS precision, {r9('recall')} AS recall, {r9('f1')} AS f1, support FROM rep",
    "report_summary": with_(PREDICTIONS) + ", " + _report_ctes("predictions", CLASSES, CLASS_NAMES)
    + "\nSELECT slice, " + ", ".join(f"{r9(c)} AS {c}" for c in [
        "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall",
        "weighted_f1"]) + ", support FROM summ",
    "metric_by_class": with_(PREDICTIONS) + ", " + _report_ctes("predictions", CLASSES, CLASS_NAMES) + """,
mm AS (SELECT slice, 'precision' AS metric, label, class_name, precision AS value FROM rep
       UNION ALL SELECT slice, 'recall', label, class_name, recall FROM rep
       UNION ALL SELECT slice, 'f1-score', label, class_name, f1 FROM rep)
SELECT slice, metric, label, class_name, round(value, 9) AS value FROM
  (SELECT *, max(value) OVER (PARTITION BY slice, metric) AS mx FROM mm) WHERE mx >= 1e-6""",
    "report_json_fields": with_(PREDICTIONS) + ", " + _report_ctes("predictions", CLASSES, CLASS_NAMES)
    + "\nSELECT s.slice, round(s.accuracy, 9) AS accuracy, round(s.accuracy, 9) AS report_accuracy, "
    + ", ".join(f"round(s.{k}_{m}, 9) AS {k}_{m}" for k in ("macro", "weighted") for m in ("precision", "recall", "f1"))
    + ", " + ", ".join(f"round(max(CASE WHEN r.class_name = '{c}' THEN r.recall END), 9) AS recall_{c}" for c in views.VECTOR_LABELS)
    + ", s.support, CAST(sum(r.tp) AS BIGINT) AS n_right FROM summ s JOIN rep r USING (slice) GROUP BY ALL",
    "argmax_predict": with_(PREDICTIONS) + """SELECT vec_id,
  CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax_all, pred_label
FROM embeddings JOIN predictions USING (vec_id)""",
    "weighted_log_loss": with_(SCORES) + f""", lse AS (
  SELECT vec_id, label AS y, ln(sum(exp(cos))) - max(CASE WHEN c = label THEN cos END) AS nll FROM scores GROUP BY vec_id, label),
c AS (SELECT y, count(*) AS n_c FROM lse GROUP BY y),
w AS (SELECT y, pow(CAST(sum(n_c) OVER () AS DOUBLE) / (CAST({CLASSES} AS DOUBLE) * n_c), {spec.CLASS_WEIGHT_ALPHA}) AS w FROM c)
SELECT CASE WHEN vec_id % 2 = 0 THEN 'en' ELSE 'de' END AS language, {r9('sum(w * nll) / sum(w)')} AS weighted_loss,
  count(*) AS n FROM lse JOIN w USING (y) GROUP BY 1""",
    "mlp_forward": """WITH h0 AS (
  SELECT vec_id, c.range AS c, (c.range % 3 - 1) / 4.0::DOUBLE
    + list_sum(list_transform(embedding, lambda x, p: CAST(x AS DOUBLE) * ((((p - 1) * 7 + c.range * 13) % 11 - 5) / 10.0::DOUBLE))) AS y
  FROM embeddings, range(8) c),
h AS (SELECT vec_id, list(greatest(y, 0.0) ORDER BY c) AS h FROM h0 GROUP BY vec_id),
o AS (
  SELECT vec_id, c.range AS c, round((c.range % 3 - 1) / 4.0::DOUBLE
    + list_sum(list_transform(h, lambda x, p: x * ((((p - 1) * 7 + c.range * 13 + 5) % 11 - 5) / 10.0::DOUBLE))), 9) AS y
  FROM h, range(10) c),
l AS (SELECT vec_id, list(y ORDER BY c) AS l FROM o GROUP BY vec_id)
SELECT vec_id, """ + ", ".join(f"l[{i + 1}] AS logit_{i}" for i in range(10)) + """,
  CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS pred_label FROM l""",
    "batched_loss": f"""WITH e AS (
  SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS l,
    (row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':{spec.SEED}'), vec_id) - 1) // {spec.BATCH_ROWS} AS batch
  FROM embeddings WHERE label BETWEEN 0 AND {CLASSES - 1}),
s AS (SELECT *, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[label + 1] AS nll,
        CAST(list_position(l, list_max(l)) - 1 = label AS INTEGER) AS good,
        pow(CAST(count(*) OVER () AS DOUBLE) / ({CLASSES} * count(*) OVER (PARTITION BY label)), {spec.CLASS_WEIGHT_ALPHA}) AS w FROM e),
b AS (SELECT batch, sum(w * nll) / sum(w) AS loss, count(*) AS n, sum(good) AS good FROM s GROUP BY batch)
SELECT {r9('sum(loss * n) / sum(n)')} AS loss, {r9('CAST(sum(good) AS DOUBLE) / sum(n)')} AS acc,
  CAST(sum(n) AS BIGINT) AS n, count(*) AS batches FROM b""",
    "csv_mixed_encoding": "SELECT doc_id, md5(text) AS text_md5, lang, source, CAST(length(text) AS INTEGER) AS chars FROM documents",
    "event_arrays": with_(RUNS) + """SELECT event_id, context_name, duration_seconds, num_texts_processed, seconds_per_text
FROM derived WHERE event_type = 'inference_run' AND event_id IS NOT NULL AND duration_seconds IS NOT NULL AND event_id % 50 <> 0""",
    "event_sink": with_(RUNS) + "SELECT event_id, context_name, event_type FROM derived",
    "leaf_records": with_(PERF) + "SELECT model_name, device, count(*) AS records, count(*) AS leaves, CAST(sum(output_embedding_dim) AS BIGINT) AS dimensions FROM perf GROUP BY 1, 2",
    "l2_normalize": """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
  sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings),
u AS (SELECT vec_id, norm, list_transform(v, lambda x: x / greatest(norm, 1e-12)) AS unit FROM n)
SELECT vec_id, round(norm, 9) AS norm, round(unit[1], 9) AS first_component, round(list_sum(unit), 9) AS component_sum,
  round(list_max(unit), 9) AS max_component,
  round(sqrt(list_sum(list_transform(unit, lambda x: x * x))), 9) AS unit_norm FROM u""",
    "event_metrics": with_(RUNS) + """SELECT event_id, avg_chars_per_text, seconds_per_text, seconds_per_1k_chars
FROM derived WHERE event_type = 'inference_run'""",
    "event_roundtrip": with_(RUNS) + """SELECT event_id, context_name, duration_seconds, num_texts_processed, seconds_per_text
FROM derived WHERE event_type = 'inference_run' AND event_id IS NOT NULL AND duration_seconds IS NOT NULL""",
    "pc_compat": _pc_compat_sql(),
    "epoch_metrics": with_(EPOCHS) + """SELECT run_id, CAST(floor(epoch / 10) AS BIGINT) AS epoch_group,
  round(sum(val_loss * CAST(n_samples AS DOUBLE)) / nullif(sum(CAST(n_samples AS DOUBLE)), 0), 9) AS loss,
  round(sum(val_acc * CAST(n_samples AS DOUBLE)) / nullif(sum(CAST(n_samples AS DOUBLE)), 0), 9) AS acc,
  CAST(sum(n_samples) AS BIGINT) AS n_samples
FROM epochs GROUP BY run_id, CAST(floor(epoch / 10) AS BIGINT)""",
    "no_improve": with_(EPOCHS, FLAGGED) + "SELECT run_id, epoch, improved, no_improve FROM flagged",
    "early_stop": with_(EPOCHS, FLAGGED) + f"""SELECT run_id, min(epoch) AS stop_epoch FROM flagged
WHERE no_improve >= {spec.PATIENCE} GROUP BY run_id""",
    "best_epoch": with_(EPOCHS, FLAGGED, STOPS) + """SELECT run_id, epoch AS best_epoch, val_loss AS best_val_loss,
  val_acc AS best_val_acc, learning_rate AS best_learning_rate FROM ranked WHERE best_pos = 1""",
    "run_summary": with_(EPOCHS, FLAGGED, STOPS, SUMMARY) + "SELECT * FROM summary",
    "epoch_lookup": with_(EPOCHS, FLAGGED, STOPS, SUMMARY) + """, pts AS (
  SELECT run_id, 'best' AS point, best_epoch AS epoch FROM summary
  UNION ALL SELECT run_id, 'past_end', best_epoch + 100000 FROM summary)
SELECT pts.run_id, pts.epoch, pts.point, e.train_acc, e.val_acc
FROM pts LEFT JOIN epochs e ON e.run_id = pts.run_id AND e.epoch = pts.epoch""",
    "model_comparison": _comparison_query(),
    "incomplete_models": _incomplete_query(),
    "markdown_rows": _markdown_query(),
    "result_paths": f"""SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, {URL_HOST} AS host,
  {URL_PATH} AS path,
  list_filter(string_split({URL_PATH}, '/'), lambda x: x <> '')[1] AS level_1,
  list_filter(string_split({URL_PATH}, '/'), lambda x: x <> '')[2] AS level_2,
  CAST(len(list_filter(string_split({URL_PATH}, '/'), lambda x: x <> '')) AS BIGINT) AS n_levels,
  regexp_extract(url, '\\?([^#]*)', 1) AS query
FROM pages""",
    "safe_names": """SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe_name,
  replace(url, ':', '_') AS model_path,
  'monitoring_events_' || regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') || '.json' AS file_name FROM pages""",
    "embed_texts": EMBED_TEXTS,
    "run_matrix": "\nUNION ALL ".join(_matrix_run(line) for line in spec.RUN_CONFIGS),
    "centroid_eval": CENTROID_EVAL,
    "post_dataset": POST_DATASET,
    "mail_dataset": MAIL_DATASET,
    "event_times": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS start_iso,
  strftime(ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f') AS end_iso,
  CAST(round(value * 1000000) AS BIGINT) / 1e6 AS elapsed_seconds,
  'monitoring_events_' || regexp_replace('user_' || CAST(user_id AS VARCHAR), '[^\\p{L}\\p{N}_-]', '_', 'g') || '_'
    || strftime(ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)), '%Y%m%d_%H%M%S') || '.json' AS file_name
FROM events""",
    "result_tree": with_(PERF) + "SELECT model_name, device, timestamp, sentences_per_second, output_embedding_dim FROM perf",
    "encode_counts": """SELECT 'hashing-32' AS model_name, 'query' AS prefix_function_name, count(*) AS num_sentences_processed,
  CAST(0 AS BIGINT) AS num_failed, CAST(32 AS BIGINT) AS output_embedding_dim, CAST(NULL AS VARCHAR) AS error FROM documents""",
    "performance_facts": f"""WITH r AS (
  SELECT user_id AS model_name, event_type AS device, CAST(sum({K}) AS BIGINT) AS n, {two_places('max(value) / 7')} AS t,
    {two_places('max(value) * 13')} - {two_places('min(value) * 3')} AS ram FROM events GROUP BY user_id, event_type)
SELECT model_name, device, n AS num_sentences_processed,
  CASE WHEN t > 0 THEN {two_places('n / t')} WHEN t IS NOT NULL AND n IS NOT NULL THEN CAST(0 AS DOUBLE) END AS sentences_per_second,
  {two_places('ram')} AS model_ram_footprint_mb FROM r""",
    "stage_reuse": """WITH n AS (SELECT count(lang) AS n FROM documents)
SELECT unnest(['first', 'again', 'half written', 'input grown', 'input as before', 'other settings']) AS step,
  unnest([true, false, true, true, false, true]) AS built, unnest([n, n, n, 2 * n, 2 * n, 2 * n]) AS n_rows FROM n""",
    "config_parse": f"""WITH c AS (SELECT page_id, {URL_HOST} || ';' || CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END
    || ';' || {str_list(spec.PREFIX_NAMES)}[page_id % 4 + 1] AS line FROM pages)
SELECT page_id, split_part(line, ';', 1) AS model_name, lower(split_part(line, ';', 2)) = 'true' AS normalize,
  split_part(line, ';', 3) AS prefix_function FROM c""",
}
