"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

B = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{B}+', ''), '{B}+$', '')"


KEY = "lpad(cast(doc_id AS varchar), 9, '0')"

PAIRS = """
im AS (SELECT vec_id // 2 AS id, list_transform(embedding, lambda x: cast(x AS double)) AS v FROM embeddings WHERE vec_id % 2 = 0),
tx AS (SELECT vec_id // 2 AS id, list_transform(embedding, lambda x: cast(x AS double)) AS v FROM embeddings WHERE vec_id % 2 = 1),
imn AS (SELECT id, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM im),
txn AS (SELECT id, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM tx),
sims AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.v, b.v) / (a.n * b.n) AS raw FROM imn a, txn b),
sim AS (SELECT i, j, raw, round(raw, 9) AS s FROM sims)
"""

RANKS = PAIRS + """,
pos AS (SELECT i AS id, s AS p FROM sim WHERE i = j),
i2t AS (SELECT i AS id, 1 + count(*) FILTER (WHERE j <> i AND (s > p OR (s = p AND j < i))) AS r
        FROM sim JOIN pos ON pos.id = sim.i GROUP BY i),
t2i AS (SELECT j AS id, 1 + count(*) FILTER (WHERE j <> i AND (s > p OR (s = p AND i < j))) AS r
        FROM sim JOIN pos ON pos.id = sim.j GROUP BY j),
ranks AS (SELECT id, i2t.r AS i2t_rank, t2i.r AS t2i_rank FROM i2t JOIN t2i USING (id))
"""

METRICS = ", ".join(
    [f"avg(CASE WHEN {d}_rank <= {k} THEN 1.0::double ELSE 0.0::double END) AS \"{d}_R_at_{k}\"" for d in ("i2t", "t2i") for k in (1, 5, 10)]
    + [f"avg(1.0::double / {d}_rank) AS \"{d}_MRR\"" for d in ("i2t", "t2i")]
    + [f"cast(quantile_disc({d}_rank, 0.5) AS double) AS \"{d}_MedR\"" for d in ("i2t", "t2i")]
)
METRIC_NAMES = [f"{d}_{m}" for d in ("i2t", "t2i") for m in ("R_at_1", "R_at_5", "R_at_10", "MRR", "MedR")]
ROUNDED_METRICS = ", ".join(f'round("{m}", 6) AS "{m}"' for m in METRIC_NAMES)

TOP = PAIRS + """,
top AS (
  SELECT i AS image_id, rank, j AS caption_id, 1 / (1 + exp(-(s * exp(2.0::double) - 1))) AS score
  FROM (SELECT *, cast(row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS int) AS rank FROM sim) WHERE rank <= 5
)
"""

LIST = """
SELECT u.image_id, coalesce(l.class_ids, '') AS class_ids
FROM (SELECT unnest(range({n})) AS image_id) u
LEFT JOIN (SELECT image_id, string_agg(cast(caption_id AS varchar), '-' ORDER BY caption_id) AS class_ids
           FROM top WHERE rank <= {k} GROUP BY image_id) l USING (image_id)
"""
N_IMAGES = "(SELECT max(id) + 1 FROM im)"

SAMPLES = f"""
samples AS (
  SELECT doc_id, lang, source AS url, {KEY} AS key, text,
    CASE WHEN doc_id % 31 = 0 THEN NULL ELSE text END AS txt,
    CASE WHEN doc_id % 17 = 0 THEN 'bad' WHEN doc_id % 19 = 0 THEN 'array' WHEN doc_id % 23 = 0 THEN 'number'
         WHEN doc_id % 7 = 0 THEN 'null' WHEN doc_id % 11 = 0 THEN 'blank' WHEN doc_id % 37 = 0 THEN 'absent' ELSE 'text' END AS kind,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 0
         WHEN doc_id % 2 = 0 THEN 8 + length(cast(doc_id AS varchar)) END AS jpg,
    CASE WHEN doc_id % 13 <> 0 AND doc_id % 2 = 1 THEN 8 + length(cast(doc_id AS varchar)) END AS png
  FROM documents),
captions AS (
  SELECT *, CASE WHEN kind = 'text' THEN text WHEN kind = 'blank' THEN '   ' END AS caption,
    CASE WHEN kind = 'text' AND lang = 'en' AND doc_id % 3 = 0 THEN 'EN ' || text END AS caption_en,
    coalesce(nullif(jpg, 0), png) AS image
  FROM samples),
chosen AS (
  SELECT *,
    coalesce(nullif({strip('caption_en')}, ''), nullif({strip('caption')}, ''), {strip('txt')}, '') AS en_first,
    coalesce(nullif({strip('caption')}, ''), {strip('txt')}, '') AS raw_caption,
    CASE WHEN {strip("CASE kind WHEN 'text' THEN text WHEN 'blank' THEN '   ' WHEN 'number' THEN NULL ELSE txt END")} <> ''
         THEN CASE kind WHEN 'text' THEN text WHEN 'blank' THEN '   ' WHEN 'number' THEN NULL ELSE txt END END AS for_translation
  FROM captions)
"""


def grams(source: str, text: str, keys: str) -> str:
    """Trigrams of ``text`` from ``source`` with the given key columns."""
    return f"""(SELECT {keys}, unnest(list_transform(range(1, len(ch) - 1), lambda i: ch[i] || ch[i+1] || ch[i+2])) AS gram
      FROM (SELECT {keys}, regexp_extract_all(regexp_replace(' ' || {text} || ' ', '[^\\p{{L}}\\p{{M}}]+', ' ', 'g'), '(?s).') AS ch FROM {source}))"""


PROFILE = f"""
counts AS (SELECT lang, gram, count(*) AS n FROM {grams('documents', 'text', 'lang')} GROUP BY lang, gram),
totals AS (SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM counts) AS size FROM counts GROUP BY lang),
vocab AS (SELECT DISTINCT gram FROM counts),
prof AS (
  SELECT v.gram, t.lang, cast(round(ln((coalesce(c.n, 0) + 1) / cast(t.size AS double)) * 1000000) AS bigint) AS lp
  FROM vocab v CROSS JOIN totals t LEFT JOIN counts c ON c.gram = v.gram AND c.lang = t.lang),
unseen AS (SELECT lang, cast(round(ln(1 / cast(size AS double)) * 1000000) AS bigint) AS lp FROM totals)
"""


def detect(source: str, text: str, keys: str) -> str:
    """CTEs ending in ``detected``: ``keys, lang, prob`` per row of ``source``."""
    on = " AND ".join(f"g.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    return f"""
per_gram AS (SELECT {keys}, gram, count(*) AS c FROM {grams(source, text, keys)} GROUP BY ALL),
gram_total AS (SELECT {keys}, sum(c) AS c FROM per_gram GROUP BY ALL),
known AS (SELECT {keys}, p.lang, sum(c * lp) AS lp, sum(c) AS c FROM per_gram JOIN prof p USING (gram) GROUP BY ALL),
scored AS (
  SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, u.lang,
         cast(coalesce(k.lp, 0) + (t.c - coalesce(k.c, 0)) * u.lp AS double) AS lp
  FROM gram_total t CROSS JOIN unseen u LEFT JOIN known k
    ON k.lang = u.lang AND {' AND '.join(f'k.{k.strip()} = t.{k.strip()}' for k in keys.split(','))}),
best AS (
  SELECT {keys}, lang, 1 / sum(exp((lp - top) / 3000000)) OVER (PARTITION BY {keys}) AS prob,
         row_number() OVER (PARTITION BY {keys} ORDER BY lp DESC, lang) AS r
  FROM (SELECT *, max(lp) OVER (PARTITION BY {keys}) AS top FROM scored)),
detected AS (
  SELECT {cols}, coalesce(g.lang, 'en') AS lang, coalesce(g.prob, 0.0::double) AS prob
  FROM {source} b LEFT JOIN (SELECT * FROM best WHERE r = 1) g ON {on})
"""


def assess(source: str, text: str) -> str:
    """CTEs ending in ``assessed`` for ``source`` with a ``doc_id``."""
    clean = strip(f"replace({strip(text)}, '#', '')")
    return f"""
variants AS (SELECT doc_id, 0 AS variant, {strip(text)} AS t FROM {source}
             UNION ALL SELECT doc_id, 1, {clean} FROM {source}),
{detect('variants', 't', 'doc_id, variant')},
assessed AS (
  SELECT s.doc_id, length(regexp_replace(c.t, '[^\\p{{L}}]', '', 'g')) AS letters,
    regexp_matches(c.t, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') AS has_cjk,
    r.t AS stripped, dr.lang, dr.prob, dc.prob AS clean_prob
  FROM {source} s
  JOIN variants r ON r.doc_id = s.doc_id AND r.variant = 0
  JOIN variants c ON c.doc_id = s.doc_id AND c.variant = 1
  JOIN detected dr ON dr.doc_id = s.doc_id AND dr.variant = 0
  JOIN detected dc ON dc.doc_id = s.doc_id AND dc.variant = 1),
judged AS (
  SELECT *, stripped <> '' AND (has_cjk OR letters >= 3) AND clean_prob >= 0.75 AS valid,
    lang = 'en' AND prob >= 0.90 AS is_identity FROM assessed),
routed AS (
  SELECT *, CASE WHEN is_identity THEN ''
    WHEN lang LIKE 'zh%' THEN 'm_zh'
    WHEN lang IN ('ja','ru','es','fr','de','ar','it','ko') THEN 'm_' || lang ELSE 'm_default' END AS model FROM judged)
"""


TRANSLATED = f"""
{SAMPLES}, {PROFILE},
usable AS (SELECT * FROM chosen WHERE for_translation IS NOT NULL),
{assess('usable', 'for_translation')},
translated AS (
  SELECT s.url, s.key, s.kind, s.doc_id, s.caption_en AS old,
    CASE WHEN r.doc_id IS NULL THEN NULL WHEN NOT r.valid THEN '' WHEN r.is_identity THEN r.stripped
         WHEN r.model = 'm_fr' THEN '' ELSE '[' || r.model || '] ' || r.stripped END AS translation
  FROM chosen s LEFT JOIN routed r USING (doc_id)),
shown AS (
  SELECT url, key, translation, CASE WHEN translation <> '' THEN translation ELSE old END AS caption_en,
    CASE WHEN kind = 'text' THEN doc_id END AS n FROM translated)
"""

HISTORY = """
hours AS (SELECT event_type AS run, date_trunc('hour', ts) AS h, round(avg(value), 6) AS val_loss FROM events GROUP BY 1, 2),
history AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY h) - 1 AS epoch, val_loss FROM hours)
"""

STOPPING = HISTORY + """,
prior AS (SELECT *, coalesce(min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::double) AS low FROM history),
marked AS (SELECT *, max(CASE WHEN val_loss < low THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM prior),
scan AS (SELECT run, epoch, val_loss, least(low, val_loss) AS best_loss, epoch - coalesce(last, -1) AS bad_epochs FROM marked),
stops AS (SELECT run, min(CASE WHEN bad_epochs >= 5 THEN epoch END) AS stop_epoch FROM scan GROUP BY run)
"""

STEPS = """
steps AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step, value AS loss FROM events)
"""

EMA = f"""
WITH RECURSIVE {STEPS},
e AS (
  SELECT run, step, loss AS ema FROM steps WHERE step = 0
  UNION ALL
  SELECT s.run, s.step, 0.9::double * e.ema + 0.1::double * s.loss FROM e JOIN steps s ON s.run = e.run AND s.step = e.step + 1
)
SELECT run, step, round(ema, 6) AS ema FROM e
"""

LOSS = PAIRS + """,
elements AS (SELECT i // 32 AS batch, i, j, 10 * raw - 10 AS x, CASE WHEN i = j THEN 1.0::double ELSE 0.0::double END AS y
             FROM sim WHERE i // 32 = j // 32),
losses AS (
  SELECT batch, avg(greatest(x, 0::double) - x * y + ln(1 + exp(-abs(x)))) AS loss, count(DISTINCT i) AS n
  FROM elements GROUP BY batch)
"""

EPOCH = f"""{RANKS}, {LOSS[len(PAIRS) + 1:]},
stats AS (
  SELECT cast(0 AS int) AS epoch, (SELECT avg(loss) FROM losses WHERE n = 32) AS train_loss,
    (SELECT avg(loss) FROM losses) AS val_loss, * FROM (SELECT {METRICS} FROM ranks))
"""

MANIFEST = HISTORY + r""",
names AS (
  SELECT run, '/ckpt/' || run || '/' || CASE epoch % 7 WHEN 3 THEN 'epoch' || epoch || 'b' WHEN 5 THEN 'epoch0' || epoch
    WHEN 6 THEN 'best' ELSE 'epoch' || epoch END AS path FROM history),
manifest AS (
  SELECT run, path, cast(regexp_extract(path, '/epoch([0-9]+)$', 1) AS bigint) AS epoch
  FROM names WHERE regexp_matches(path, '/epoch[0-9]+$'))
"""

def split_score(key: str) -> str:
    acc = "0"
    for i in range(4):
        acc = f"(({acc}) * 967296 + cast('0x' || substr(md5({key}), {8 * i + 1}, 8) AS bigint)) % 1000000"
    return f"({acc}) / 1000000.0::double"


TRAINABLE = "coalesce(image, 0) > 0 AND length(en_first) > 0"

BATCHES = f"""
{SAMPLES},
scored AS (SELECT url, key, en_first AS caption, image, {split_score('key')} AS score FROM chosen WHERE {TRAINABLE}),
numbered AS (
  SELECT CASE WHEN score < 0.95 THEN 'train' ELSE 'val' END AS split, url, key, caption, image FROM scored),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY split, url ORDER BY md5('0:' || key || chr(1) || caption)) - 1 AS pos,
    count(*) OVER (PARTITION BY split, url) AS n FROM numbered),
kept AS (
  SELECT *, pos // 16 AS batch, least(64, len(CASE WHEN caption = '' THEN [] ELSE string_split_regex(caption, '{B}+') END)) AS w
  FROM placed WHERE split = 'val' OR (pos // 16 + 1) * 16 <= n)
"""

TOKENS = f"""
tok AS (SELECT doc_id, source, CASE WHEN {strip('text')} = '' THEN [] ELSE string_split_regex({strip('text')}, '{B}+') END AS t FROM documents),
cut AS (SELECT *, t[1:64] AS c FROM tok),
wide AS (SELECT *, max(len(c)) OVER (PARTITION BY source) AS w FROM cut)
"""


def padded(x: str, width: str) -> str:
    return f"array_to_string(list_concat({x}, list_transform(range(greatest({width} - len({x}), 0)), lambda i: '[PAD]')), ' ')"


B_NOT = B.replace("[", "[^", 1)


def ids(t: str, n: int) -> str:
    return f"array_to_string(list_concat(list_transform({t}[1:{n}], lambda x: length(x)), list_transform(range(greatest({n} - len({t}), 0)), lambda x: 0)), ' ')"


BUFFER = """
placed AS (SELECT doc_id, source, coalesce(source, '') AS shard, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
  count(*) OVER (PARTITION BY source) AS n FROM documents),
slots AS (SELECT *, CASE WHEN i < 250 THEN i ELSE cast('0x' || substr(md5('7:' || shard || ':' || i), 1, 8) AS bigint) % 250 END AS slot FROM placed),
taken AS (SELECT *, lead(i) OVER (PARTITION BY source, slot ORDER BY i) AS taken_by FROM slots),
given AS (SELECT doc_id, source, md5('7:' || shard) AS shard_order, CASE WHEN taken_by IS NOT NULL THEN taken_by - 250
  ELSE n - least(n, 250) + row_number() OVER (PARTITION BY source, taken_by IS NULL ORDER BY md5('7:' || shard || ':end:' || slot), slot) - 1 END AS position
  FROM taken)
"""


KINDS = "['Lora_A', 'lora_B', 'bias', 'proj.LORA_UP', 'weight'][label % 5 + 1]"
AUDIT = f"""
named AS (
  SELECT 'layer.' || vec_id || '.' || {KINDS} AS name,
    list_transform(embedding, lambda x: CASE WHEN vec_id % 41 = 0 THEN 0.0::double ELSE cast(x AS double) END) AS f FROM embeddings),
audit AS (
  SELECT name, sqrt(list_dot_product(f, f)) AS norm FROM named
  WHERE regexp_matches(lower(name), 'lora_a|lora_b|lora_up|lora_down'))
"""

REPORT = " UNION ALL ".join(
    f"SELECT run, epoch, '{name}' AS metric, round(\"{column}\", 6) AS value FROM (SELECT 'r0' AS run, * FROM stats)"
    for name, column in [("val_loss", "val_loss")] + [(m.replace("_at_", "@"), m) for m in METRIC_NAMES]
)


def letter(c: str) -> str:
    return f"(length(text) - length(replace(text, '{c}', '')))"


NORM8 = "sqrt(" + " + ".join(f"{letter(c)} * {letter(c)}" for c in "abcdefgh") + ")"

LINES = rf"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS caption_id, line AS caption FROM (
        SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE {strip("regexp_replace(text, '[\r\n]+', ' ', 'g')")} END AS line FROM documents)
        WHERE line <> ''"""

ORACLE: dict[str, str] = {
    "retrieval_metrics": f"WITH {RANKS} SELECT {ROUNDED_METRICS} FROM (SELECT {METRICS} FROM ranks)",
    "retrieval_ranks": f"WITH {RANKS} SELECT * FROM ranks",
    "retrieval_ranks_by_lanes": f"WITH {RANKS} SELECT * FROM ranks",
    "paired_score": f"WITH {PAIRS} SELECT i AS id, round(s, 6) AS score FROM sim WHERE i = j",
    "predict_topk": f"WITH {TOP} SELECT image_id, rank, caption_id, round(score, 6) AS score FROM top",
    "predict_topk_by_lanes": f"WITH {TOP} SELECT image_id, rank, caption_id, round(score, 6) AS score FROM top",
    "predict_top1": f"WITH {TOP} SELECT image_id, caption_id, round(score, 6) AS score FROM top WHERE rank = 1",
    "prediction_coo": f"WITH {TOP} SELECT image_id, caption_id AS class_id, cast(1 AS int) AS value FROM top",
    "pairs_csv_roundtrip": f"WITH {TOP} SELECT image_id, caption_id AS class_id, cast(1 AS int) AS value FROM top",
    "submission": f"WITH {TOP} {LIST.format(n=f'{N_IMAGES} + 3', k=5)}",
    "submission_roundtrip": f"WITH {TOP} {LIST.format(n=f'{N_IMAGES} + 3', k=5)}",
    "merge_submissions": f"""WITH {TOP}, a AS ({LIST.format(n=N_IMAGES, k=5)}), b AS ({LIST.format(n=N_IMAGES, k=1)})
        SELECT * FROM a UNION ALL SELECT image_id + (SELECT count(*) FROM a), class_ids FROM b""",
    "prediction_preview": f"""WITH {TOP} SELECT image_id, rank, caption_id, round(score, 4) AS score, text AS caption
        FROM top JOIN documents ON doc_id = caption_id WHERE image_id < 5""",
    "caption_en_first": f"WITH {SAMPLES} SELECT key, en_first AS caption FROM chosen",
    "caption_raw": f"WITH {SAMPLES} SELECT key, raw_caption AS caption FROM chosen",
    "caption_for_translation": f"WITH {SAMPLES} SELECT key, for_translation AS caption FROM chosen",
    "caption_coercion": "SELECT doc_id, text AS from_text, text AS from_bytes, cast(n_chars AS varchar) AS from_number FROM documents",
    "pick_image": f"WITH {SAMPLES} SELECT key, image AS n_bytes, coalesce(image > 0, false) AS usable FROM chosen",
    "language_profile": f"WITH {PROFILE} SELECT * FROM counts",
    "detect_language": f"WITH {PROFILE}, {detect('documents', 'text', 'doc_id')} SELECT doc_id, lang, round(prob, 4) AS prob FROM detected",
    "caption_validity": f"WITH {PROFILE}, {assess('documents', 'text')} SELECT doc_id, letters, has_cjk, valid FROM routed",
    "route_model": f"WITH {PROFILE}, {assess('documents', 'text')} SELECT doc_id, lang, model, is_identity FROM routed",
    "route_groups": f"""WITH {PROFILE}, {assess('documents', 'text')}
        SELECT model, count(*) AS n, (count(*) + 63) // 64 AS n_batches FROM routed WHERE valid AND NOT is_identity GROUP BY model""",
    "translate_samples": f"WITH {TRANSLATED} SELECT key, translation, caption_en, n FROM shown",
    "translate_dealt": f"WITH {TRANSLATED} SELECT key, translation, caption_en, n FROM shown",
    "translate_shards": f"WITH {TRANSLATED} SELECT url AS shard, key, caption_en, n FROM shown",
    "stream_translate_shards": f"WITH {TRANSLATED} SELECT url AS shard, key, caption_en, n FROM shown",
    "stream_translate": f"WITH {TRANSLATED} SELECT key, translation, caption_en, n FROM shown",
    "caption_coverage": f"""WITH {SAMPLES} SELECT url, count(*) AS total, count(caption_en) AS has_caption_en,
        round(count(caption_en) / cast(count(*) AS double), 3) AS ratio FROM captions GROUP BY url""",
    "caption_coverage_total": f"""WITH {SAMPLES} SELECT count(*) AS total, count(caption_en) AS has_caption_en,
        round(count(caption_en) / cast(count(*) AS double), 3) AS ratio FROM captions""",
    "translated_examples": f"WITH {SAMPLES} SELECT url, key, caption_en FROM captions WHERE caption_en IS NOT NULL ORDER BY url, key LIMIT 10",
    "split_train_val": f"""SELECT key, score, CASE WHEN score < 0.95 THEN 'train' ELSE 'val' END AS split
        FROM (SELECT key, {split_score('key')} AS score FROM (SELECT {KEY} AS key FROM documents))""",
    "training_batches": f"""WITH {BATCHES} SELECT split, url, key, batch, pos % 16 AS row_in_batch, caption,
        max(w) OVER (PARTITION BY split, url, batch) AS width FROM kept""",
    "training_batches_from_shards": f"""WITH {BATCHES} SELECT split, url AS shard, key, batch, pos % 16 AS row_in_batch, caption,
        max(w) OVER (PARTITION BY split, url, batch) AS width, image AS n_bytes FROM kept""",
    "pad_tokens": f"""WITH {TOKENS} SELECT doc_id, len(c) AS n_cut, len(t) AS n_tokens,
        {padded('c', 'w')} AS longest, {padded('t', '128')} AS fixed FROM wide""",
    "batch_loss": f"WITH {LOSS} SELECT batch, round(loss, 6) AS loss, n FROM losses",
    "pair_loss": f"""WITH {PAIRS}, p AS (SELECT i AS id, s * exp(2.0::double) - 1 AS x FROM sim WHERE i = j)
        SELECT id, round(greatest(x, 0::double) - x + ln(1 + exp(-abs(x))), 6) AS loss FROM p""",
    "mean_loss": f"WITH {LOSS} SELECT round(avg(loss), 6) AS mean_loss, count(*) AS n_batches FROM losses",
    "alignment_check": f"""WITH {PAIRS} SELECT round(avg(raw) FILTER (WHERE i = j) * exp(2.0::double), 6) AS diag,
        round(avg(raw) FILTER (WHERE i <> j) * exp(2.0::double), 6) AS off FROM sim""",
    "vector_audit": f"WITH {AUDIT} SELECT name, round(norm, 6) AS norm, norm = 0 AS is_zero FROM audit",
    "vector_audit_summary": f"WITH {AUDIT} SELECT count(*) AS n_vectors, count(*) FILTER (WHERE norm = 0) AS n_zero FROM audit",
    "early_stopping": f"WITH {STOPPING} SELECT scan.*, stop_epoch FROM scan JOIN stops USING (run)",
    "stop_epoch": f"WITH {STOPPING} SELECT * FROM stops",
    "best_epoch": f"""WITH {HISTORY} SELECT run, epoch, val_loss FROM
        (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS r FROM history) WHERE r = 1""",
    "epoch_stats": f"""WITH {EPOCH} SELECT epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, {ROUNDED_METRICS} FROM stats""",
    "metric_report": f"WITH {EPOCH} {REPORT}",
    "ema_loss": EMA,
    "stream_ema": EMA,
    "logged_steps": f"WITH {STEPS} SELECT run, step, loss FROM steps WHERE (step + 1) % 50 = 0",
    "epoch_manifest": f"WITH {MANIFEST} SELECT * FROM manifest",
    "retention_plan": f"""WITH {MANIFEST}
        SELECT *, false AS keep, 'all' AS mode FROM manifest
        UNION ALL SELECT *, epoch <> 4, 'epoch' FROM manifest
        UNION ALL SELECT *, epoch = max(epoch) OVER (PARTITION BY run), 'keep_latest' FROM manifest""",
    "shard_roundtrip": f"""WITH {SAMPLES} SELECT url AS shard, key, txt, jpg AS jpg_bytes, png AS png_bytes, caption FROM captions""",
    "shard_errors": """SELECT DISTINCT source AS shard, ['cut short', 'damaged header', 'repeated member', 'no tar'][cast(source[4:] AS int) % 5 + 1] AS kind
        FROM documents WHERE cast(source[4:] AS int) % 5 < 4""",
    "shards_with_errors": f"""SELECT shard, key, n_bytes FROM (SELECT source AS shard, {KEY} AS key, strlen(text) AS n_bytes,
        cast(source[4:] AS int) % 5 AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
        WHERE kind IN (2, 4) OR kind < 2 AND r <= 2""",
    "json_rewrite": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'NaN, ' || doc_id WHEN 1 THEN NULL WHEN 2 THEN 'é' || doc_id ELSE 'a' END AS caption,
        CASE doc_id % 4 WHEN 0 THEN '{"x": NaN, "caption": "NaN, ' || doc_id || '", "caption_en": "new ' || doc_id || '"}'
        WHEN 1 THEN '{"big": 12345678901234567890123456789012345678901234' || doc_id || ', "caption_en": "new ' || doc_id || '"}'
        WHEN 2 THEN '{"x": {"y": [1, 2.5, null, true]}, "caption": "é' || doc_id || '", "caption_en": "new ' || doc_id || '"}'
        ELSE '{"k": ' || doc_id || ', "caption": "a", "caption_en": "new ' || doc_id || '"}' END AS json FROM documents""",
    "json_array_file": """SELECT doc_id // 2000 AS slot, row_number() OVER (PARTITION BY doc_id // 2000 ORDER BY doc_id) - 1 AS caption_id,
        text AS caption FROM documents""",
    "buffer_shuffle": f"WITH {BUFFER} SELECT doc_id, source, shard_order, position FROM given",
    "encode_tokens": rf"""SELECT doc_id, len(t) AS n_tokens, CASE WHEN len(t) > 128 THEN regexp_extract(text, '^{B}*({B_NOT}+{B}+){{0,127}}{B_NOT}+') ELSE text END AS kept,
        {ids('t', 128)} AS ids, {ids('t', 64)} AS caption_ids, repeat('1', least(len(t), 64)) || repeat('0', 64 - least(len(t), 64)) AS caption_mask
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{B_NOT}+') AS t FROM documents)""",
    "run_summary": f"""WITH {STOPPING}, best AS (SELECT run, min_by(epoch, (val_loss, epoch)) AS epoch, min(val_loss) AS val_loss FROM history GROUP BY run)
        SELECT run, stop_epoch, epoch, metric, CASE WHEN metric = 'val_loss' THEN round(val_loss, 6) END AS value FROM best JOIN stops USING (run),
        (SELECT unnest(['val_loss', {", ".join("'" + m.replace("_at_", "@") + "'" for m in METRIC_NAMES)}]) AS metric)""",
    "line_list": LINES,
    "submission_from_lists": f"""WITH lines AS ({LINES}),
        t AS (SELECT caption_id, length(caption) % 11 AS n FROM lines),
        best AS (SELECT w, caption_id, row_number() OVER (PARTITION BY w ORDER BY round((w * n + (7 - w) * (10 - n))
          / sqrt(w * w + (7 - w) * (7 - w)) / sqrt(n * n + (10 - n) * (10 - n)), 6) DESC, caption_id) AS r FROM (SELECT unnest(range(2, 7)) AS w), t),
        listed AS (SELECT w, string_agg(cast(caption_id AS varchar), '-' ORDER BY caption_id) AS class_ids FROM best WHERE r <= 5 GROUP BY w)
        SELECT u.image_id, coalesce(class_ids, '') AS class_ids FROM (SELECT unnest(range((SELECT max(doc_id) + 1 FROM documents))) AS image_id) u
        LEFT JOIN documents ON doc_id = u.image_id AND doc_id % 29 <> 0 AND doc_id % 13 <> 0 LEFT JOIN listed ON w = 2 + doc_id % 5""",
    "image_paths": f"SELECT doc_id AS image_id, '/data/imgs/' || {KEY} || '.png' AS path FROM documents",
    "json_array_list": """SELECT doc_id, i - 1 AS caption_id, l[i] AS caption FROM
        (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "metadata_export": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "image_scan": """SELECT doc_id AS image_id, cast(2 AS int) AS height, cast(2 + doc_id % 5 AS int) AS width, cast(3 AS int) AS channels
        FROM documents WHERE doc_id % 29 <> 0 AND doc_id % 13 <> 0""",
    "unreadable_images": "SELECT doc_id AS image_id FROM documents WHERE doc_id % 29 = 0 OR doc_id % 13 = 0",
    "dataset_profile": """SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS null_captions, min_by(text, doc_id) AS first_caption,
        count(*) FILTER (WHERE NOT ok) AS null_images, cast(min_by(3, doc_id) FILTER (WHERE ok) AS int) AS first_channels,
        cast(min(2) FILTER (WHERE ok) AS int) AS min_height, cast(max(2) FILTER (WHERE ok) AS int) AS max_height,
        cast(min(2 + doc_id % 5) FILTER (WHERE ok) AS int) AS min_width, cast(max(2 + doc_id % 5) FILTER (WHERE ok) AS int) AS max_width
        FROM (SELECT *, doc_id % 29 <> 0 AND doc_id % 13 <> 0 AS ok FROM documents)""",
    "export_samples": f"""WITH {SAMPLES}, first AS (
        SELECT key, image, en_first FROM chosen WHERE {TRAINABLE} AND {split_score('key')} < 0.95 ORDER BY key LIMIT 50)
        SELECT 'sample_' || lpad(cast(row_number() OVER (ORDER BY key) - 1 AS varchar), 5, '0') || '.jpg' AS name,
        image AS n_bytes, en_first AS caption FROM first""",
    "encode_embeddings": "SELECT doc_id, " + ", ".join(
        f"round(cast({letter(c)} / greatest({NORM8}, 1e-12) AS float)::double, 4) AS f{i}" for i, c in enumerate("abcdefgh")
    ) + " FROM documents",
}

# Another way to the same samples.
ORACLE["shards_by_format"] = ORACLE["stream_shards"] = ORACLE["shard_roundtrip"]
