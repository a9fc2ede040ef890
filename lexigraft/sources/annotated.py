"""Annotated text: PubTator blocks, BioC-XML and bulk tables, as raw documents (schemas.RAW_DOCUMENT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import place


def pubtator_blocks(blocks: DataFrame) -> DataFrame:
    """Parse rows with a text column `value`, one block of lines each.

    A line with |t| anywhere is a title, one with |a| an abstract; of several
    titles the last begins the document anew, so what came before it is lost.
    Tab-separated lines with six or more fields and a number second are
    entities, other lines with four or more are relations, shorter ones are skipped.
    """
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.rtrim(F.regexp_replace(x, "\r$", ""))), lambda x: x != "")
    rows = blocks.select(lines.alias("lines")).filter(F.size("lines") > 0)
    is_title = lambda x: F.contains(x, F.lit("|t|"))
    starts = F.filter(F.transform("lines", lambda x, i: F.when(is_title(x), i)), lambda i: i.isNotNull())
    rows = rows.select(F.slice("lines", F.coalesce(F.array_max(starts), F.lit(0)) + 1, F.size("lines")).alias("lines"))
    title = F.try_element_at(F.filter("lines", is_title), F.lit(1))
    abstract = F.try_element_at(F.filter("lines", lambda x: ~is_title(x) & F.contains(x, F.lit("|a|"))), F.lit(-1))
    fields = F.filter(F.transform(F.filter("lines", lambda x: ~is_title(x) & ~F.contains(x, F.lit("|a|"))), lambda x: F.split(x, "\t")), lambda f: F.size(f) >= 4)
    entity = lambda f: (F.size(f) >= 6) & F.get(f, F.lit(1)).rlike(r"^\d+$")
    at = lambda f, i: F.get(f, F.lit(i))
    rows = rows.select(title.alias("t"), abstract.alias("a"), fields.alias("f"))
    body = lambda c, mark: F.substring(c, F.instr(c, mark) + 3, F.lit(1 << 30))
    return rows.filter("t is not null").select(
        F.substring_index("t", "|t|", 1).alias("pmid"),
        body(F.col("t"), F.lit("|t|")).alias("title"),
        F.coalesce(body(F.col("a"), F.lit("|a|")), F.lit("")).alias("abstract"),
        F.transform(F.filter("f", entity), lambda f: F.struct(at(f, 1).cast("int").alias("start"), at(f, 2).cast("int").alias("end"), at(f, 3).alias("mention"), at(f, 4).alias("entity_type"), at(f, 5).alias("code"), at(f, 6).alias("extra"))).alias("entities"),
        F.transform(F.filter("f", lambda f: ~entity(f)), lambda f: F.struct(at(f, 1).alias("relation_type"), at(f, 2).alias("subject"), at(f, 3).alias("object"), at(f, 4).alias("novelty"), F.lit(None).cast("double").alias("score"))).alias("relations"),
    )


def read_pubtator(spark: SparkSession, path: str) -> DataFrame:
    """Files whose blocks are parted by an empty line; lines may end with \\n or \\r\\n, each file in its own way."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    ends = lines.groupBy("file").agg(F.count_if(F.endswith("value", F.lit("\r"))).alias("crlf"), F.count("*").alias("n"))
    files = {r.file: "\r\n\r\n" if 2 * r.crlf > r.n else "\n\n" for r in ends.collect()}  # a name and a flag for each file
    out = None
    for separator in sorted(set(files.values())) or ["\n\n"]:
        own = [f for f, s in files.items() if s == separator] or path
        rows = spark.read.option("lineSep", separator).text(own)
        out = rows if out is None else out.unionByName(rows)
    return pubtator_blocks(out.select(F.explode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("value")))


INFON = "array<struct<_key: string, _VALUE: string>>"
BIOC = (
    "id string, "
    f"passage array<struct<infon: {INFON}, offset: int, text: string, "
    f"annotation: array<struct<_id: string, infon: {INFON}, location: array<struct<_offset: int, _length: int>>, text: string>>>>, "
    f"relation array<struct<infon: {INFON}, node: array<struct<_role: string, _refid: string>>>>"
)


def infon(infons: Column, *keys: str) -> Column:
    """The first non-empty value among the keys, in the order of the keys."""
    value = lambda k: F.trim(F.try_element_at(F.filter(infons, lambda i: i["_key"] == k), F.lit(1))["_VALUE"])
    some = lambda v: F.try_element_at(F.filter(F.array(v), lambda x: x != ""), F.lit(1))  # noqa: E731  # nullif() would make the value twice
    return F.coalesce(*(some(value(k)) for k in keys), F.lit(""))


def bioc_documents(rows: DataFrame, silver: bool = False) -> DataFrame:
    """Raw documents of BioC rows (schema BIOC).

    Offsets move from the file's passages to the joined text. In the corpus form
    the first passage that holds an annotation's start counts, passages of other
    types add no text although they move what follows, and so do further titles;
    in the silver form the last passage that begins before it counts, every text
    is added and relations carry a score and coded roles.
    """
    passages = F.transform(
        F.coalesce("passage", F.expr("array()").cast("array<struct<infon: array<struct<_key: string, _VALUE: string>>, offset: int, text: string, annotation: array<struct<_id: string, infon: array<struct<_key: string, _VALUE: string>>, location: array<struct<_offset: int, _length: int>>, text: string>>>>")),
        lambda p: F.struct(F.lower(infon(p["infon"], "type")).alias("kind"), F.coalesce(p["offset"], F.lit(0)).alias("offset"), F.coalesce(p["text"], F.lit("")).alias("text"), p["annotation"].alias("annotation")),
    )
    rows = rows.withColumn("_p", passages)
    cursor = F.aggregate("_p", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, p: F.struct((s["at"] + F.char_length(p["text"]) + 1).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
    rows = rows.withColumn("_c", cursor)
    titled = lambda p: p["kind"] == "title"
    title = F.coalesce(F.try_element_at(F.filter("_p", lambda p: titled(p) & (p["text"] != "")), F.lit(1))["text"], F.lit(""))
    first = F.coalesce(F.array_position(F.transform("_p", lambda p: titled(p) & (p["text"] != "")), F.lit(True)), F.lit(0)) - 1
    if silver:
        chosen = F.filter("_p", lambda p, i: (p["text"] != "") & (i != first))
    else:
        chosen = F.filter("_p", lambda p: (p["text"] != "") & p["kind"].isin("abstract", "paragraph", "section", ""))
    abstract = F.array_join(F.transform(chosen, lambda p: p["text"]), " ")

    # columns and structs, or each entity and each end of each relation makes its inputs anew
    rows = rows.withColumn("_m", F.zip_with("_p", "_c", lambda p, c: F.struct(p["offset"].alias("low"), (p["offset"] + F.char_length(p["text"])).alias("high"), (c - p["offset"]).alias("by"))))

    def moved(start: Column) -> Column:
        hits = F.filter("_m", (lambda m: m["low"] <= start) if silver else (lambda m: (m["low"] <= start) & (start <= m["high"])))
        return F.coalesce(F.try_element_at(hits, F.lit(-1 if silver else 1))["by"], F.lit(0))

    located = F.filter(F.flatten(F.transform("_p", lambda p: F.coalesce(p["annotation"], F.expr("array()").cast("array<struct<_id: string, infon: array<struct<_key: string, _VALUE: string>>, location: array<struct<_offset: int, _length: int>>, text: string>>")))), lambda a: F.size(F.coalesce(a["location"], F.expr("array()").cast("array<struct<_offset: int, _length: int>>"))) > 0)

    def placed(a: Column) -> Column:
        spot = F.element_at(a["location"], 1)
        return F.struct(a.alias("a"), spot.alias("spot"), moved(spot["_offset"]).alias("by"))

    def entity(x: Column) -> Column:
        a, spot = x["a"], x["spot"]
        return F.struct(
            a["_id"].alias("ref"), (spot["_offset"] + x["by"]).alias("start"), (spot["_offset"] + spot["_length"] + x["by"]).alias("end"), F.coalesce(a["text"], F.lit("")).alias("mention"),
            infon(a["infon"], "type", "ner_type", "entity_type").alias("entity_type"), infon(a["infon"], "MESH", "identifier", "NCBI Gene", "identifier_raw").alias("code"), F.lit(None).cast("string").alias("extra"),
        )

    rows = rows.withColumn("_e", F.transform(F.transform(located, placed), entity))
    rows = rows.withColumn("_k", F.transform("_e", lambda e: F.struct(e["ref"].alias("ref"), F.nullif(e["code"], F.lit("")).alias("code"))))
    coded = lambda ref: F.coalesce(F.try_element_at(F.filter("_k", lambda k: k["ref"] == ref), F.lit(-1))["code"], ref)

    def ends(r: Column) -> Column:
        """A relation with its two ends as they stand in it: codes in the silver form, else annotations."""
        if silver:
            subject, object_ = infon(r["infon"], "role1"), infon(r["infon"], "role2")
        else:
            subject = F.coalesce(F.try_element_at(r["node"], F.lit(1))["_refid"], F.lit(""))
            object_ = F.coalesce(F.try_element_at(F.filter(F.transform(r["node"], lambda n: F.coalesce(n["_refid"], F.lit(""))), lambda x: x != subject), F.lit(1)), F.lit(""))
        return F.struct(r["infon"].alias("infon"), subject.alias("subject"), object_.alias("object"))

    def relation(r: Column) -> Column:
        score = F.try_cast(infon(r["infon"], "score"), "double") if hasattr(F, "try_cast") else infon(r["infon"], "score").try_cast("double")
        end = lambda ref: ref if silver else F.when(ref != "", coded(ref)).otherwise(ref)
        return F.struct(infon(r["infon"], "type", "relation").alias("relation_type"), end(r["subject"]).alias("subject"), end(r["object"]).alias("object"), F.lit("").alias("novelty"), score.alias("score"))

    none = F.expr("array()").cast("array<struct<infon: array<struct<_key: string, _VALUE: string>>, node: array<struct<_role: string, _refid: string>>>>")
    relations = F.filter(F.transform(F.transform(F.coalesce("relation", none), ends), relation), lambda r: (r["subject"] != "") & (r["object"] != ""))
    return rows.select(F.coalesce(F.trim("id"), F.lit("")).alias("pmid"), title.alias("title"), abstract.alias("abstract"), F.transform("_e", lambda e: e.dropFields("ref")).alias("entities"), relations.alias("relations"))


def read_bioc(spark: SparkSession, path: str, silver: bool = False) -> DataFrame:
    """BioC-XML files; broken documents of the silver form are skipped, others raise."""
    rows = spark.read.format("xml").option("rowTag", "document").option("mode", "DROPMALFORMED" if silver else "FAILFAST").schema(BIOC).load(path)
    return bioc_documents(rows, silver)


def read_bulk(spark: SparkSession, path: str, names: tuple[str, ...], least: int = 4, parts: int = 0) -> DataFrame:
    """A tab-separated bulk file, also gzipped: the first columns by name, rows with fewer than `least` fields skipped.

    A gzip file is one task; parts deals its rows out anew.
    """
    lines = spark.read.text(path)
    lines = lines.select(F.split("value", "\t").alias("f"), place(lines).alias("ord")).filter(F.size("f") >= least)
    out = lines.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)), "ord")
    return out.repartition(parts, "pmid") if parts and "pmid" in names else out


def concept_hits(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pmid, code) of bulk concept rows (pmid, type, code, mentions) whose code is wanted, once each."""
    own = rows.select("pmid", F.explode(F.split(F.regexp_replace("code", "MESH:", ""), "[;|,]")).alias("code"))
    return own.join(wanted.select("code").distinct(), "code", "left_semi").select("pmid", "code").distinct()
