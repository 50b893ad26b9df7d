"""DuckDB SQL of those queries that SQL can express. The others rest on hashes, models or vocabularies that
DuckDB lacks; tests hold them against plain versions."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, s, md5_number(array_to_string(list_slice(w, s, s + 19), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
first AS (SELECT k, min((doc_id, s)) AS f FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM win JOIN first USING (k) WHERE (doc_id, s) <> f),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
pattern AS (SELECT DISTINCT item, least(13, len(w)) AS m, list_slice(w, s, s + least(13, len(w)) - 1) AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
hit AS (SELECT doc_id, s, m, item FROM (SELECT doc_id, s, m, list_slice(w, s, s + m - 1) AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM pattern))) JOIN pattern USING (m, k)),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS i FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS MATERIALIZED (SELECT doc_id, s, md5_number(h[2 * s + 1 : 2 * s + 100]) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM d)),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY 1 HAVING count(*) > 1),
starts AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM win JOIN first USING (k) WHERE doc_id > f),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM starts) GROUP BY 1, 2),
gaps AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nxt FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, min(a) AS head, string_agg(h[2 * b + 1 : 2 * coalesce(nxt, n)], '' ORDER BY a) AS rest, any_value(h) AS h FROM gaps JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN d.h ELSE k.h[1 : 2 * head] || rest END)) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)"""

# DuckDB has no crc32: its table by the polynomial's rule, then byte by byte over the text in hexadecimal
_CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)))"


def _crc(text: str) -> str:
    """crc32 of the text's UTF-8 bytes; crc_table must be joined."""
    digit = lambda at: f"(instr('0123456789ABCDEF', hex(encode({text}))[{at}]) - 1)"  # noqa: E731
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: {digit('2 * i + 1')} * 16 + {digit('2 * i + 2')})"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP12 = f"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
voc AS MATERIALIZED (SELECT word, {_crc('word')} % 10000 AS b FROM (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)), crc_table),
source AS (SELECT b, count(*) AS n FROM dw JOIN voc USING (word) GROUP BY 1), target AS (SELECT b, count(*) AS n FROM bw JOIN voc USING (word) GROUP BY 1),
gain AS (SELECT r.b, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS g FROM range(10000) r(b) LEFT JOIN source s ON s.b = r.b LEFT JOIN target t ON t.b = r.b),
weights AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM dw JOIN voc USING (word) JOIN gain USING (b) GROUP BY 1),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, rank FROM scored s LEFT JOIN (SELECT doc_id, rank FROM ranked WHERE rank <= 10 * n // 100) r ON r.doc_id = s.doc_id"""

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

BASE = f"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_crc('doc_id::VARCHAR')} % 7 = 2 AS held_out, list_append({_SPACED.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")}, ' ') AS w FROM documents, crc_table),
tok AS (SELECT doc_id, held_out, unnest(w) AS word FROM d), known AS MATERIALIZED (SELECT word, count(*) AS c FROM tok WHERE NOT held_out GROUP BY 1),
total AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM known)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 6) AS base_score FROM tok LEFT JOIN known USING (word), total GROUP BY 1, 2"""

COUNTS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
win AS (SELECT doc_id, s, list_slice(w, s, s + 4) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d)),
again AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 5)) FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS m FROM win) WHERE m > 1) GROUP BY 1),
dup AS (SELECT doc_id, sum(m - 1)::BIGINT AS n FROM (SELECT doc_id, line, count(*) AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-]') GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(again.n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id)"""

SQL = {"op2_substring_dedup": OP2, "op4_benchmark_decontamination": OP4, "op5_suffix_array_dedup": OP5, "op12_importance_resampling": OP12, "lm_base_scores": BASE, "quality_counts": COUNTS}
