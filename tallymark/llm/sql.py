"""Oracle SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

# Each list entry from 0 on is a byte to mix in, each -1 a shift by one bit; the polynomial is the reversed one of CRC-32.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text that is not empty."""
    return _CRC32.format(text=text)


def _framed(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_framed(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE_MANIFEST = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '.' || source END AS tree, {_leaf("text")} AS leaf,
        CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS found
    FROM documents),
leaves AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
up AS (
    SELECT tree, 0 AS lvl, place AS pos, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM leaves
    UNION ALL
    SELECT tree, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 2) // 3)
    FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3),
subroots AS (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE n = 1),
above AS (
    SELECT 0 AS lvl, place AS pos, d, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 2) // 3)
    FROM above WHERE n > 1 GROUP BY lvl, pos // 3),
ways AS (
    SELECT k, lvl, pos, d, place // (3 ** lvl)::BIGINT AS own FROM leaves JOIN up USING (tree)
    WHERE n > 1 AND pos // 3 = place // (3 ** (lvl + 1))::BIGINT
    UNION ALL
    SELECT k, 1000 + a.lvl, a.pos, a.d, s.place // (3 ** a.lvl)::BIGINT
    FROM leaves JOIN subroots s USING (tree) JOIN above a ON a.n > 1 AND a.pos // 3 = s.place // (3 ** (a.lvl + 1))::BIGINT),
steps AS (
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY lvl) AS i,
        coalesce(string_agg(d, '' ORDER BY pos) FILTER (pos < own), '') AS before, coalesce(string_agg(d, '' ORDER BY pos) FILTER (pos > own), '') AS after
    FROM ways GROUP BY k, lvl),
folded AS (
    SELECT k, 0::BIGINT AS i, found AS d FROM leaves
    UNION ALL
    SELECT k, s.i, sha256(s.before || f.d || s.after) FROM folded f JOIN steps s USING (k) WHERE s.i = f.i + 1),
proofs AS (SELECT k, string_agg(before || after, '' ORDER BY i) AS siblings, max(i) AS last FROM steps GROUP BY k)
SELECT l.doc_id, l.leaf, s.d AS subroot, r.d AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN above r ON r.n = 1 LEFT JOIN proofs p USING (k) JOIN folded f ON f.k = l.k AND f.i = coalesce(p.last, 0)
"""
