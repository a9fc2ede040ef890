"""Files that the library writes and reads again."""

import os

from lexigraft.sources.documents import read_documents, write_documents

SF = "/root/testdata/sf0.001"


def test_json_lines_are_compressed(spark, tmp_path):
    """Documents come back whole from files of less than a fourth of their lines' size."""
    from pyspark.sql import functions as F

    from lexigraft.plans.annotation_queries import documents

    docs = documents(spark, SF)
    path = str(tmp_path / "docs")
    write_documents(docs, path)
    size = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.startswith("part-"))
    plain = docs.select(F.sum(F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))).first()[0]
    assert size < plain / 4
    assert not docs.select(F.to_json(F.struct("*"))).exceptAll(read_documents(spark, path).select(*docs.columns).select(F.to_json(F.struct("*")))).count()
