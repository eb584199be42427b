"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _windows(size: str) -> str:
    """Windows of ``size`` words of the list ``w`` with their places."""
    return f"unnest(list_transform(range(1, len(w) - {size} + 2), lambda i: {{'i': i, 'p': array_to_string(w[i:i + {size} - 1], ' ')}}))"


ORACLE = {
    "op2_decontamination": f"""
        WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
        b AS (SELECT item, w, least(len(w), 13) AS n FROM (
            SELECT cast(item_id AS varchar) AS item, {_PLAIN} AS w FROM benchmark) WHERE len(w) > 0),
        pattern AS (SELECT DISTINCT item, n, x.p AS p FROM (SELECT item, n, {_windows('n')} AS x FROM b)),
        place AS (SELECT doc_id, n, x.i AS i, x.p AS p FROM (
            SELECT doc_id, n, {_windows('n')} AS x FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, i, n, item FROM place JOIN pattern USING (n, p)),
        words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
            FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x AS double))) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.w, c.w) AS bigint) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank FROM scored)
        WHERE rank <= 10""",
    "op10_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN
            list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        overlap AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY ALL),
        link AS (SELECT x, y FROM overlap JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
        reach(doc_id, near) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.near)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(near) AS component_id
        FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id""",
    "op11_ranked_search": f"""
        WITH t AS (SELECT r, doc_id, unnest({_PLAIN}) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
        d AS (SELECT r, any_value(doc_id) AS doc_id, cast(count(*) AS bigint) AS n FROM t GROUP BY r),
        total AS (SELECT cast(count(*) AS bigint) AS nd, cast(sum(n) AS bigint) AS l FROM d),
        norm AS (SELECT r, doc_id, 100 - 90 + ((90 * n * nd) // l) AS m FROM d, total),
        tf AS (SELECT r, term, cast(count(*) AS bigint) AS tf FROM t GROUP BY r, term),
        item AS (SELECT DISTINCT item_id, unnest({_PLAIN}) AS term FROM benchmark),
        weight AS (SELECT term, cast(floor(1000 * ln(cast(2 * any_value(nd) + 2 AS double) / (2 * count(*) + 1))) AS bigint) AS w
            FROM tf, total GROUP BY term),
        scored AS (SELECT item_id, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS bigint) AS score
            FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN norm USING (r) WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, r)
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 10""",
    # The crc32 table is worked out by its rule: eight shifts, each with the polynomial where a one drops out.
    "op12_spelling_variants": f"""
        WITH RECURSIVE shift AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
        run AS (SELECT coalesce(cast(doc_id AS varchar), '') AS id, run, count(*) AS k FROM (
            SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
        hashed AS (SELECT run, k, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
            lambda ch: CASE WHEN unicode(ch) < 128 THEN [cast(unicode(ch) AS bigint)] ELSE [195, unicode(ch) - 64] END))),
            lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM run, shift),
        cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
        words AS (SELECT word, cast(sum(k) AS bigint) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        left_out AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (SELECT a.word AS word, b.word AS near FROM left_out a JOIN left_out b ON a.hole = b.hole AND a.word <> b.word
            UNION SELECT a.word, b.word FROM left_out a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word FROM left_out a JOIN words b ON a.rest = b.word),
        best AS (SELECT near.word, count(*) AS n_near, min({{'less': -words.n, 'near': near.near}}) AS best
            FROM near JOIN words ON words.word = near.near GROUP BY near.word),
        form AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.near END AS form,
            CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n FROM words LEFT JOIN best USING (word)),
        chain(word, root, step) AS (SELECT word, coalesce(form, word), 0 FROM form
            UNION ALL SELECT chain.word, form.form, step + 1 FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NOT NULL)
        SELECT word, form, root, n, n_near, cast(form_n AS bigint) AS form_n
        FROM form JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) USING (word)""",
}
