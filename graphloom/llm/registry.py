"""Queries of this subpackage and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from graphloom.llm import audit, fim
from graphloom.llm.audit import op12_filter_audit
from graphloom.llm.decontaminate import op1_decontamination
from graphloom.llm.fim import op11_fill_in_middle
from graphloom.llm.htmltext import op5_html_text
from graphloom.llm.mixing import op2_mixing
from graphloom.llm.packing import op13_packing
from graphloom.llm.quality import op6_quality
from graphloom.llm.secrets import op4_secrets
from graphloom.llm.sharding import op8_sharding
from graphloom.llm.simhash import op9_simhash
from graphloom.llm.suffixdedup import op3_suffix_dedup
from graphloom.llm.tokencounts import op7_token_counts
from graphloom.llm.tokenfiles import op10_token_files

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secrets": op4_secrets,
    "op5_html_text": op5_html_text,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_simhash": op9_simhash,
    "op10_token_files": op10_token_files,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_packing": op13_packing,
}

#: DuckDB statements. The other operators rest on hashes, permutations, models or
#: tokenizers that SQL lacks; tests/llm has brute-force versions of them.
SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH iw AS (
    SELECT coalesce(cast(item_id AS VARCHAR), '') AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(list_slice(w, i, i + 12), ' ') AS words
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0) x
), dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), spots AS (
    SELECT doc_id, size, p.i, p.words
    FROM (SELECT doc_id, size, unnest(list_transform(range(1, greatest(len(w) - size + 1, 0) + 1), lambda i: struct_pack(i := i, words := array_to_string(list_slice(w, i, i + size - 1), ' ')))) AS p
          FROM dw, (SELECT DISTINCT size FROM win) z) x
), hit AS (SELECT spots.doc_id, spots.i, spots.size, win.item FROM spots JOIN win ON spots.size = win.size AND spots.words = win.words),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) x GROUP BY 1),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) x GROUP BY 1)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op6_quality": r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), tri AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n
    FROM (SELECT doc_id, p.i, p.t FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(i := i, t := w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS p FROM d) x) y
), rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM tri WHERE n > 1) x GROUP BY 1),
m AS (
    SELECT d.doc_id, source, cast(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           len(lines) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_words < 50) AS a, count(*) FILTER (WHERE 100 * n_repeat_words > 50 * n_words) AS b,
       count(*) FILTER (WHERE 10 * n_symbols > n_words) AS c, count(*) FILTER (WHERE 10 * n_dup_lines > 3 * n_lines) AS d FROM b GROUP BY 1),
e AS (SELECT source, n, 'short' AS rule, a AS bad FROM h UNION ALL SELECT source, n, 'repeated', b FROM h UNION ALL SELECT source, n, 'symbols', c FROM h UNION ALL SELECT source, n, 'lines', d FROM h),
p AS (SELECT rule, avg(bad / n) AS m, coalesce(var_samp(bad / n), 0) AS v, avg(1 / n) AS one FROM e GROUP BY 1),
q AS (SELECT rule, m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * one, 1e-6) - 1, 0) + 1e-3 AS w FROM p),
s AS (SELECT source, rule, m, n + w AS weight, round((bad + m * w) / (n + w), 9) AS shown, (bad + m * w) / (n + w) AS rate FROM e JOIN q USING (rule)),
v AS (SELECT source, max(shown) AS top, bool_or(rate > 0.5 AND rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) > m) AS failed FROM s GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept,
       (SELECT max(rule) FROM s WHERE s.source IS NOT DISTINCT FROM b.source AND shown = top) AS host_rule, round(top, 4) AS host_rate
FROM b JOIN v ON v.source IS NOT DISTINCT FROM b.source""",
    "op11_fill_in_middle": fim.SQL,
    "op12_filter_audit": audit.SQL,
}
