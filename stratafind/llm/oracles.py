"""DuckDB SQL that is put together by rule: the plain forms of operators 11 and 13."""

from __future__ import annotations

from . import elkan_codes


def _lloyd(parts: int = elkan_codes.PARTS, entries: int = elkan_codes.ENTRIES, rounds: int = elkan_codes.ROUNDS) -> str:
    """Lloyd's rounds one after another, every part against every entry, in whole numbers."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({elkan_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""part AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x FROM kept, range({parts}) AS r(p))""",
        f"""book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part QUALIFY e < {entries})""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min([d, e]) AS best FROM (
                SELECT vec_id, part.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM part JOIN book{k} USING (p)) GROUP BY vec_id, p)"""
        )
        if k < rounds:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(new, c) AS c FROM book{k} LEFT JOIN (
                    SELECT p, e, list(m ORDER BY i) AS new FROM (
                        SELECT p, best[2] AS e, i, (sum(x[i])::BIGINT - (sum(x[i])::BIGINT % count(*) + count(*)) % count(*)) // count(*) AS m FROM near{k}, range(1, len(x) + 1) AS r(i) GROUP BY p, best[2], i
                    ) GROUP BY p, e) USING (p, e))"""
            )
    last = rounds
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{last} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{last}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


def _crc_table() -> list[int]:
    """The 256 steps of the reflected polynomial of CRC-32."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


LLOYD = _lloyd()

SPELLING = f"""
    WITH RECURSIVE run AS (SELECT doc_id, r, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents) GROUP BY doc_id, r),
    byte AS (SELECT r, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM run),
    crc AS (SELECT r, c, xor(list_reduce(list_prepend(4294967295, b), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) AS h FROM byte, (SELECT {_crc_table()}::BIGINT[] AS t)),
    word AS MATERIALIZED (SELECT w AS word, sum(c)::BIGINT AS n FROM (
        SELECT c, CASE WHEN h % 97 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS w FROM crc) WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
    less AS (SELECT word, left(word, i::INT) || substr(word, i::INT + 2) AS short FROM word, range(0, length(word)) AS r(i)),
    wild AS (SELECT word, left(word, i::INT) || '*' || substr(word, i::INT + 2) AS k FROM word, range(0, length(word)) AS r(i)),
    shorter AS (SELECT less.word AS a, word.word AS b FROM less JOIN word ON short = word.word),
    pair AS (SELECT a, b FROM shorter UNION SELECT b, a FROM shorter UNION SELECT x.word, y.word FROM wild x JOIN wild y ON x.k = y.k AND x.word <> y.word),
    near AS (SELECT a AS word, b, n AS n_b, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM pair JOIN word ON b = word.word),
    formed AS MATERIALIZED (SELECT word.word, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_b >= 2 * word.n THEN b END AS form, CASE WHEN n_b >= 2 * word.n THEN n_b END AS form_n FROM word LEFT JOIN near ON near.word = word.word AND k = 1),
    way AS (SELECT word, word AS at FROM formed UNION ALL SELECT way.word, formed.form FROM way JOIN formed ON formed.word = way.at WHERE formed.form IS NOT NULL)
    SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN way ON way.word = f.word JOIN formed last ON last.word = way.at AND last.form IS NULL
"""
