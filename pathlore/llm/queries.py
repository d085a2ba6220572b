"""Queries of the corpus operators over the whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm import chats, contamination, context_tree, exact_dedup, licenses, line_dedup, merkle, mixing, phrases, quality, secrets, simhash, token_counts
from pathlore.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op5_mix_sources")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5)


@query("op1_secrets")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


@query("op2_context_tree")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return context_tree.context_tree_scores(table(spark, sf_dir, "documents"), held_out)


@query(
    "op3_decontamination",
    r"""
    WITH i AS (
      SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM benchmark WHERE text IS NOT NULL
    ), iw AS (SELECT item_id, words, least(5, len(words)) AS width FROM i WHERE len(words) > 0
    ), s AS (
      SELECT DISTINCT item_id, width, unnest([array_to_string(words[k:k + width - 1], ' ') for k in range(1, len(words) - width + 2)]) AS shingle FROM iw
    ), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id
    ), d AS (
      SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL
    ), ds AS (
      SELECT DISTINCT doc_id, width, unnest([array_to_string(words[k:k + width - 1], ' ') for k in range(1, len(words) - width + 2)]) AS shingle
      FROM d, (SELECT DISTINCT width FROM iw) WHERE len(words) >= width
    )
    SELECT doc_id, item_id, any_value(n.n) AS item_shingles, count(*) AS shared, count(*) / any_value(n.n) AS containment
    FROM ds JOIN s USING (width, shingle) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n.n) >= 0.8
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))
    return r"""
    WITH t AS (
      SELECT template, license, list_filter(regexp_split_to_array(lower(notice), '[^\pL\pN]+'), lambda w: w <> '') AS words FROM (VALUES ROWS) v(template, license, notice)
    ), ts AS (SELECT DISTINCT template, license, unnest([array_to_string(words[k:k + 4], ' ') for k in range(1, len(words) - 3)]) AS shingle FROM t
    ), tn AS (SELECT template, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS upper FROM ts GROUP BY template
    ), shape AS (SELECT template, n, greatest(1, upper // 2) AS step, upper + greatest(1, upper // 2) - CASE WHEN upper = 1 THEN 1 ELSE 0 END AS length FROM tn
    ), d AS (
      SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL
    ), dw AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM d
    ), ds AS (
      SELECT doc_id, k - 1 AS place, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS shingle
      FROM dw WINDOW o AS (PARTITION BY doc_id ORDER BY k)
    ), hit AS (
      SELECT doc_id, place, shingle, template, license, n, step, length FROM ds JOIN ts USING (shingle) JOIN shape USING (template)
    ), w AS (
      SELECT *, unnest(range(CAST(greatest(0, ceil((place - (length - 1)) / step)) AS BIGINT), place // step + 1)) * step AS start FROM hit
    ), c AS (
      SELECT doc_id, license, template, start, count(DISTINCT shingle) / any_value(n) AS containment, min(place) AS first_word
      FROM w GROUP BY doc_id, license, template, start HAVING count(DISTINCT shingle) / any_value(n) >= 0.8
    )
    SELECT doc_id, license, max(containment) AS containment, min(first_word) AS first_word, count(DISTINCT template) AS templates FROM c GROUP BY doc_id, license
    """.replace("ROWS", rows)


@query("op7_licenses", _license_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), model="piece_bpe_32k.model", limit=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query(
    "op9_line_dedup",
    r"""
    WITH RECURSIVE l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS place FROM documents
    ), k AS (SELECT doc_id, place, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l
    ), u AS (SELECT line, length(line) AS n, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM k WHERE line <> '')
    ), v AS (SELECT * FROM u WHERE n >= 32
    ), c AS (
      SELECT a.id AS a, b.id AS b, a.line AS x, b.line AS y FROM v a JOIN v b ON b.n = a.n AND left(a.line, a.n // 2) = left(b.line, a.n // 2) AND a.id < b.id
      UNION SELECT a.id, b.id, a.line, b.line FROM v a JOIN v b ON b.n = a.n AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) AND a.id < b.id
      UNION SELECT a.id, b.id, a.line, b.line FROM v a JOIN v b ON b.n = a.n + 1 AND left(a.line, a.n // 2) = left(b.line, a.n // 2)
      UNION SELECT a.id, b.id, a.line, b.line FROM v a JOIN v b ON b.n = a.n + 1 AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)
    ), e AS (SELECT a, b FROM c WHERE levenshtein(x, y) <= 1 UNION SELECT b, a FROM c WHERE levenshtein(x, y) <= 1
    ), r AS (SELECT DISTINCT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a
    ), m AS (SELECT id, min(other) AS class FROM r GROUP BY id
    ), o AS (
      SELECT doc_id, place, row_number() OVER (PARTITION BY coalesce(m.class, u.id) ORDER BY doc_id, place) AS nth FROM k JOIN u USING (line) LEFT JOIN m ON m.id = u.id
    ), d AS (SELECT doc_id, count(*) AS n, string_agg(place, ',' ORDER BY place) AS copies FROM o WHERE nth > 1 GROUP BY doc_id)
    SELECT t.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(d.n, 0) AS n_copies, coalesce(d.copies, '') AS copies
    FROM documents t LEFT JOIN d ON d.doc_id = t.doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query(
    "op10_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
    ), g AS (
      SELECT doc_id, length(text) AS size, sha256(norm) AS sha, row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS place,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM t
    )
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha AS text_sha256 FROM g
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query(
    "op11_phrases",
    r"""
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents
    ), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p
    ), g AS (
      SELECT lang, size, unnest([array_to_string(words[k:k + size - 1], ' ') for k in range(1, len(words) - size + 2)]) AS gram
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(words) >= size
    ), t AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang
    ), f AS (SELECT lang, size, gram, count(*) AS a FROM g GROUP BY lang, size, gram HAVING count(*) >= 100
    ), i AS (
      SELECT lang, a, unnest(flatten([[array_to_string(string_split(gram, ' ')[k:k + m - 1], ' ') for k in range(1, size - m + 2)] for m in range(2, size)])) AS gram FROM f WHERE size > 2
    ), c AS (SELECT lang, gram, max(a) AS cover FROM i GROUP BY lang, gram
    ), k AS (
      SELECT lang, gram, size, a, unnest(range(1, size)) AS cut FROM f LEFT JOIN c USING (lang, gram) WHERE size > 1 AND (cover IS NULL OR 100 * cover < 100 * a)
    ), s AS (
      SELECT k.lang, k.gram, k.a, cut, x.a AS l, y.a AS r, t.n, CAST((1000 * k.a::HUGEINT * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
      FROM k JOIN t ON t.lang = k.lang
      JOIN f x ON x.lang = k.lang AND x.gram = array_to_string(string_split(k.gram, ' ')[1:cut], ' ')
      JOIN f y ON y.lang = k.lang AND y.gram = array_to_string(string_split(k.gram, ' ')[cut + 1:], ' ')
    ), b AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) AS nth FROM s
    ), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM b WHERE nth = 1)
    SELECT lang, rank, gram AS phrase, a, l, r, n, score FROM o WHERE rank <= 2000
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, cover=100, top=2000)


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _climb_sql(path: str, nodes: str, key: str) -> str:
    """Paths (id, key, level, i, n, cur, sibs) up a binary tree: the other node of each run, and what the nodes give."""
    return f"""
      SELECT p.id, p.{key}, p.level + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN p.cur WHEN p.i % 2 = 0 THEN p.cur || s.h ELSE s.h || p.cur END), p.sibs || coalesce(s.h, '')
      FROM {path} p LEFT JOIN {nodes} s ON s.{key} = p.{key} AND s.level = p.level AND s.i = CASE WHEN p.i % 2 = 0 THEN p.i + 1 ELSE p.i - 1 END WHERE p.n > 1"""


_MERKLE = f"""
    WITH RECURSIVE c AS (
      SELECT *, coalesce('=' || lang, '') AS g, coalesce(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
        lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 7 = 0, false) AS hit FROM documents
    ), l AS (
      SELECT doc_id, g, sha256({' || '.join(_FIELD.format(f) for f in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS leaf,
        sha256({' || '.join(_FIELD.format(f) for f in ('doc_id', 'source', 'lang', 'CASE WHEN hit THEN n_chars + 1 ELSE n_chars END', 'text'))}) AS other FROM c
    ), r AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l
    ), nd(g, level, i, n, h) AS (
      SELECT g, 0, i, n, leaf FROM r
      UNION ALL SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nd WHERE n > 1 GROUP BY g, level, i // 2, n
    ), sb AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, 0 AS one FROM nd WHERE n = 1
    ), td(one, level, i, n, h) AS (
      SELECT one, 0, i, n, subroot FROM sb
      UNION ALL SELECT one, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM td WHERE n > 1 GROUP BY one, level, i // 2, n
    ), up(id, g, level, i, n, cur, sibs) AS (SELECT id, g, 0, i, n, other, '' FROM r UNION ALL {_climb_sql('up', 'nd', 'g')}
    ), tp(id, one, level, i, n, cur, sibs) AS (SELECT up.id, one, 0, sb.i, sb.n, up.cur, up.sibs FROM up JOIN sb USING (g) WHERE up.n = 1 UNION ALL {_climb_sql('tp', 'td', 'one')})
    SELECT doc_id, leaf, subroot, td.h AS root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = td.h AS verified
    FROM r JOIN sb USING (g) JOIN tp ON tp.id = r.id AND tp.n = 1 JOIN td ON td.n = 1
    """


@query("op13_merkle", _MERKLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


@query("op12_chats")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", mark), (-1, 1, "assistant", mark)], "conv_id long, turn long, role string, text string")
    return chats.chat_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))
