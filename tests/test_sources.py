"""Readers and writers on small files."""

import pytest

from lexigraft import sources as S
from lexigraft.functions import constants as C
from lexigraft.operators import documents as D
from lexigraft.sources import documents
from lexigraft.sources.documents import cached
from lexigraft.streaming import mention_counts, windowed_counts

PUBTATOR = "1|t|Lost\n2|t|Asp |t| x\n2|a|Ill now\n2\t0\t3\tAsp\tChemical\tD000001\n2\t8\t11\tIll\tDisease\tD000002,D000003\tnote\n2\t5\tfive\tfields\tonly\n2\tCID\tD000001\tD000009,D000002,D000003\n2\tCID\tD000001\tD000002,D000003\tNovel\n\n3|t|Alone\n3|a|\n"
BIOC = """<collection><document><id>9</id>
<passage><infon key="type">title</infon><offset>0</offset><text>Tit</text><annotation id="a1"><infon key="type">Chemical</infon><infon key="MESH">D1</infon><location offset="0" length="3"/><text>Tit</text></annotation></passage>
<passage><infon key="type">fig</infon><offset>10</offset><text>figs</text></passage>
<passage><infon key="type">abstract</infon><offset>20</offset><text>Abs tract</text><annotation id="a2"><infon key="type">Disease</infon><infon key="identifier">D2</infon><location offset="24" length="5"/><text>tract</text></annotation><annotation id="a3"><text>nowhere</text></annotation></passage>
<relation><infon key="type">CID</infon><infon key="score">0.9</infon><infon key="role1">Chemical|D1</infon><infon key="role2">Disease|D2</infon><node role="Subject" refid="a1"/><node role="Object" refid="a2"/></relation>
</document></collection>"""


@pytest.fixture
def annotated(spark, tmp_path):
    (tmp_path / "a.txt").write_text(PUBTATOR)
    return S.read_pubtator(spark, str(tmp_path / "a.txt"))


def test_pubtator(annotated):
    got = {r.pmid: r for r in annotated.collect()}
    assert set(got) == {"2", "3"} and got["2"].title == "Asp |t| x" and got["3"].abstract == ""
    assert [e.code for e in got["2"].entities] == ["D000001", "D000002,D000003"] and got["2"].entities[1].extra == "note"
    assert [r.relation_type for r in got["2"].relations] == ["5", "CID", "CID"] and got["2"].relations[2].novelty == "Novel"


def test_documents(spark, annotated, tmp_path):
    docs = D.assemble(annotated, C.scope(spark), "BC5CDR", "dev")
    mapped = spark.createDataFrame([("D000001", "100", 0.9, True), ("D000002", "200", 0.95, False), ("D000003", "300", 0.8, True)], "code string, target_id string, confidence double, target_active boolean")
    stamped = D.stamp_relations(D.stamp_concepts(docs, mapped), C.relation_table(spark))
    got = {r.pmid: r for r in stamped.collect()}["2"]
    assert [(e.mapped_id, e.mapping_confidence) for e in got.entities] == [("100", 0.9), ("300", 0.8)]
    assert [(r.subject_idx, r.object_idx, r.target_relation, r.tier) for r in got.relations] == [(0, 1, "causes", 2)] and not got.relations[0].extra.default_used
    S.write_documents(stamped, str(tmp_path / "docs"))
    again = S.read_documents(spark, str(tmp_path / "docs"))
    assert sorted(r.pmid for r in again.collect()) == ["2", "3"]
    kept = D.split_audit(D.assemble_split([again], "dev", ("BC5CDR",), True)).collect()
    assert [(r.cause, r.documents) for r in kept] == [("kept", 2)]
    inactive = D.stamp_concepts(docs, mapped.filter("code = 'D000002'"))
    dropped = {r.pmid: r["drop"] for r in D.eligibility(inactive).collect()}
    assert dropped["2"].cause == "no_verified_mapping" and dropped["3"] is None
    with pytest.raises(Exception, match="not a gold corpus"):
        D.assemble_split([again], "test", ("Other",), True).count()


@pytest.mark.parametrize("silver", [False, True])
def test_bioc(spark, tmp_path, silver):
    (tmp_path / "b.xml").write_text(BIOC)
    got = S.read_bioc(spark, str(tmp_path / "b.xml"), silver).first()
    assert got.title == "Tit" and got.abstract == ("figs Abs tract" if silver else "Abs tract")
    assert [(e.start, e.end, e.code) for e in got.entities] == [(0, 3, "D1"), (13, 18, "D2")]
    assert (got.relations[0].subject, got.relations[0].object) == (("Chemical|D1", "Disease|D2") if silver else ("D1", "D2"))


def test_rrf(spark, tmp_path):
    (tmp_path / "MRSTY.RRF").write_text('C1|T1|S|"Quoted|a|b|\nC2|T2|S|Short\n\nC3|T3|S|Long|a|b|c|d|\n')
    got = {r.cui: r for r in S.read_rrf(spark, str(tmp_path / "MRSTY.RRF"), "MRSTY").collect()}
    assert got["C1"].sty == '"Quoted' and got["C2"].cvf == "" and got["C3"].cvf == "b" and len(got) == 3


def test_release_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text('id\tactive\tconceptId\tterm\n1\t1\tc\t"open\n2\t0\tc\tx\n')
    got = S.read_reference_set(spark, str(tmp_path / "d.txt"), active_only=True).collect()
    assert [(r.concept_id, r.term) for r in got] == [("c", '"open')]


def test_cache(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\n")
    built = []
    build = lambda: built.append(1) or spark.read.text(str(tmp_path / "in.txt"))
    for _ in range(2):
        assert cached(spark, str(tmp_path / "c"), [str(tmp_path / "in.txt")], build).count() == 1
    (tmp_path / "in.txt").write_text("a\nbb\n")
    assert cached(spark, str(tmp_path / "c"), [str(tmp_path / "in.txt")], build).count() == 2 and len(built) == 2


def test_streams(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text('{"t": "2024-01-01T00:00:01", "k": "a"}\n{"t": "2024-01-01T00:00:02", "k": "a"}\n{"t": "2024-01-01T00:09:00", "k": "b"}\n')
    stream = lambda: spark.readStream.schema("t timestamp, k string").json(str(tmp_path / "s"))
    for name, df, mode in (("counts", mention_counts(stream(), "k"), "complete"), ("windows", windowed_counts(stream(), "t", "k", "1 minute", "2 minutes"), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT k, frequency FROM counts").collect()) == [("a", 2), ("b", 1)]
    assert sorted((r.k, r.n) for r in spark.sql("SELECT * FROM windows").collect()) == [("a", 2), ("b", 1)]


def test_pubtator_line_ends(spark, tmp_path):
    block = "{0}|t|Title {0}\n{0}|a|Text.\n{0}\t0\t5\tTitle\tDisease\tD1\n"
    text = "\n".join(block.format(i) for i in (1, 2, 3))
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "c.txt").write_bytes((block.format(4) + "\n" + block.format(5).replace("\n", "\r\n") + "\r\n" + block.format(6)).encode())
    got = S.read_pubtator(spark, str(tmp_path)).collect()
    assert sorted(r.pmid for r in got) == sorted(["1", "2", "3"] * 2 + ["4", "5", "6"])
    assert all(r.title == f"Title {r.pmid}" and r.abstract == "Text." and [e.code for e in r.entities] == ["D1"] for r in got)


def test_mapping_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("mesh_id,snomed_id,confidence,snomed_active\nD1,1,0.5,true\nD2, ,0.9,true\nD3,3,n/a,TRUE\nD4,4,,\nD1,7,0.6,false\n")
    got = documents.read_mapping(spark, str(tmp_path / "m.csv"))
    assert sorted(map(tuple, got.collect())) == [("D1", "7", 0.6, False), ("D3", "3", 0.0, True), ("D4", "4", 0.0, False)]
    assert sorted(r.code for r in documents.read_mapping(spark, str(tmp_path / "m.csv"), skip_bad=True).collect()) == ["D1", "D4"]


def test_json_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "b": [1,\n 2]\n}')
    assert documents.read_json(spark, str(tmp_path / "a.json")).first().b == [1, 2]


def test_first_match(spark, tmp_path):
    for name in ("x_2.txt", "x_1.txt"):
        (tmp_path / name).write_text("")
    assert documents.first_match(spark, [f"{tmp_path}/y*", f"{tmp_path}/x*"]).endswith("x_1.txt")
    assert documents.first_match(spark, [f"{tmp_path}/y*"]) is None
