"""The thin queries op1 to op13: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_viterbi import encode

    found = encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), decoded=True)
    return found.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("decoded_chars"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .int8_neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decision_list import fit, judge

    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    stats = [F.col(f"_stats.{s}").alias(s) for s in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *stats, "base_failed", "rule", "kept")


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_mixing import score

    return score(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_rules import scan

    return scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(fold(3) != 1))
    return model.score(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import new_path
    from .warc import archive, read

    path = new_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return read(spark, path, payload=False, verify=True).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pow2_packing import decompose, sequences

    pieces = decompose(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .feistel_order import read, write
    from .shared import new_path

    path = new_path(spark, "order")
    write(table(spark, sf_dir, "documents"), path, key=20, tokenizer=tokenizer("word_bpe_49k.json"))
    return read(spark, path).select("slot", "sequence", "shard", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damage, summaries

    rows = table(spark, sf_dir, "conversations")
    return summaries(damage(rows), rows)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import phrases

    return phrases(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit

    docs = table(spark, sf_dir, "documents")
    found = fit(docs.filter(fold(4) != 2)).predict(docs.select("doc_id", "text"))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_near_duplicates, op3_embedding_neardup, op4_quality_rules, op5_context_mixing, op6_license_scan, op7_toxicity, op8_warc, op9_packing, op10_training_order, op11_conversation_repair, op12_collocations, op13_language_id)}

_REACH = """
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT id, id FROM ids UNION SELECT r.id, b.b FROM reach r JOIN ways b ON b.a = r.other),
label AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
"""



def _add(path: str, cost: int, edit: str) -> str:
    """SQL that adds an edit to a path, a cost of nine digits and the edits' initials."""
    return f"lpad(CAST(CAST(left({path}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({path}, 10) || '{edit}'"


def _with_inserts(s: str, y: str, u: str, a: str) -> str:
    """SQL of u and a when turns may be put in: the least path in each state."""
    once = lambda p: _add(p, 2, "I")
    twice = lambda p: _add(p, 4, "II")
    return f"least({u}, {once(s)}, {once(y)}, {once(a)}) AS u, least({a}, {once(u)}, {twice(s)}, {twice(y)}) AS a"


#: The CRC-32 of an ASCII text `key`, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
  lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

#: Exact SQL where there is any; learned and tokenizer-based results have none, their tests hold brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": f"""
WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i : i + 4], ' ') ELSE array_to_string(ws, ' ') END AS shingle
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM label LEFT JOIN n ON doc_id = id""",
    "op3_embedding_neardup": f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH}, k AS (SELECT a, count(*) AS n FROM ways GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM label LEFT JOIN k ON a = id""",
    "op12_collocations": r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS ws FROM (
       SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY 1),
f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, ws[i : i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM p, range(1, 6) AS t(k))) GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT lang, g[i : i + m - 1] AS g, max(f) AS longer FROM (SELECT lang, g, f, m, unnest(generate_series(1, k - m + 1)) AS i FROM f JOIN range(2, 5) AS t(m) ON m < k) GROUP BY ALL),
c AS (SELECT f.lang, f.g, k, f AS a, n FROM f JOIN n USING (lang) LEFT JOIN inside ON inside.lang = f.lang AND inside.g = f.g WHERE k > 1 AND (longer IS NULL OR 100 * longer < 100 * f)),
s AS (SELECT c.lang, array_to_string(c.g, ' ') AS phrase, a, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c) AS c JOIN f AS l ON l.lang = c.lang AND l.g = c.g[1 : cut] JOIN f AS r ON r.lang = c.lang AND r.g = c.g[cut + 1 : c.k]
      QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s QUALIFY rank <= 2000""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
w AS (SELECT *, {_CRC} % 20 AS way FROM k),
d AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(generate_series(1, CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM w WHERE way <> 0),
o AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
f AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM o),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
r AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS s, NULL::VARCHAR AS y, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM facts
  UNION ALL SELECT conv_id, i, {_add("s", 3, "D")}, least({_add("y", 3, "D")}, CASE WHEN may AND initial = 's' THEN {_add("s", "worse", "K")} END),
    least({_add("u", 3, "D")}, CASE WHEN may AND initial = 'u' THEN least({", ".join(_add(p, "worse", "K") for p in "sya")}) END, CASE WHEN may THEN least({", ".join(_add(p, "2 + worse", "R") for p in "sya")}) END),
    least({_add("a", 3, "D")}, CASE WHEN may AND initial = 'a' THEN {_add("u", "worse", "K")} END, CASE WHEN may THEN {_add("u", "2 + worse", "R")} END)
  FROM (SELECT f.conv_id, f.i, f.initial, f.fault IN (0, 3) AS may, CASE f.fault WHEN 3 THEN 1 ELSE 0 END AS worse, r.s, r.y, {_with_inserts("r.s", "r.y", "r.u", "r.a")} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)),
best AS (SELECT conv_id, substr(p, 10) AS audit, CAST(left(p, 9) AS BIGINT) AS cost FROM (SELECT conv_id, least(s, a) AS p FROM (SELECT r.conv_id, r.s, {_with_inserts("r.s", "r.y", "r.u", "r.a")} FROM r JOIN facts ON facts.conv_id IS NOT DISTINCT FROM r.conv_id AND facts.n = r.i))),
e AS (SELECT conv_id, pos, audit[pos] AS edit FROM (SELECT conv_id, audit, unnest(generate_series(1, len(audit))) AS pos FROM best)),
p AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM e),
t AS (SELECT p.conv_id, pos, edit, role, CASE edit WHEN 'I' THEN '' ELSE text END AS text, row_number() OVER w AS j, first_value(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER w AS system
  FROM p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE edit <> 'D' WINDOW w AS (PARTITION BY p.conv_id ORDER BY pos)),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos)) AS sha FROM t GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
