"""Structure files through Spark's reader, as a table and as a stream; targets that appear whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from fernwave.sources import formats, structures


def line(record="ATOM", serial=1, atom="CA", resname="GLY", chain="A", resseq="1", x="1.000", occupancy="1.00"):
    return f"{record:<6}{serial:>5}  {atom:<3} {resname:>3} {chain}{resseq:>4}    {x:>8}{'2.000':>8}{'-3.500':>8}{occupancy:>6}{'10.00':>6}"


def files(folder):
    os.makedirs(folder / "structure_id=two")
    odd = [line(), line(chain="B", resseq="7", x="nothing"), line("HETATM", resname="LIG", resseq="x", occupancy=""), "REMARK", "ATOM", line(resseq="-3", x="+4.5"), "ENDMDL", line(chain="Z")]
    (folder / "one.pdb").write_text("\r\n".join(odd))
    (folder / "structure_id=two" / "part.txt").write_text("\n".join([line(chain="É"), line(chain="B", resseq="12")]) + "\n")
    (folder / "empty.pdb").write_text("")
    (folder / "_hidden.pdb").write_text(line(chain="H"))


def test_same_atoms_as_the_plain_reader(spark, tmp_path):
    files(tmp_path)
    got = formats.read_structures(spark, str(tmp_path), together=100)  # a task for each file
    want = structures.read_atoms(spark, [str(tmp_path / "one.pdb"), str(tmp_path / "structure_id=two"), str(tmp_path / "empty.pdb")]).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 7
    assert got.rdd.getNumPartitions() == 3


def test_conditions_reach_the_files(spark, tmp_path):
    files(tmp_path)
    read = lambda **only: formats.read_structures(spark, str(tmp_path), only=only)
    assert [(x.structure_id, x.resseq) for x in read(chain=["B"], resseq=[7, 9]).filter("x IS NULL").collect()] == [("one", 7)]
    assert read(structure_id=["two", "three"]).count() == 2 and read(structure_id=["none"]).count() == 0
    assert read(chain=["É"]).count() == 1 and read(resseq=[-99, 0]).count() == 1 and read(record=["HETATM"], chain=["A"]).count() == 1
    every = read()  # conditions of one query do not stay for the next
    assert [every.filter(c).count() for c in ("structure_id = 'none'", "resseq < 0 OR chain = 'É'", "true")] == [0, 2, 7]
    reader = formats.StructureReader({"path": str(tmp_path), "only": '{"structure_id": ["two"]}'})
    assert [p.paths for p in reader.partitions()] == [[str(tmp_path / "structure_id=two" / "part.txt")]]
    with pytest.raises(Exception, match="no condition on x"):
        read(x=[1]).count()
    with pytest.raises(Exception, match="nowhere"):
        formats.read_structures(spark, str(tmp_path / "nowhere")).count()


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(folder)
    formats.register(spark)

    def run():
        q = spark.readStream.format("structure_files").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination(60)

    (folder / "a.pdb").write_text(line())
    run()
    (folder / "b.pdb").write_text(line() + "\n" + line(chain="B"))
    run()
    run()
    assert sorted((r.structure_id, r["count"]) for r in spark.read.parquet(out).groupBy("structure_id").count().collect()) == [("a", 1), ("b", 2)]


ROWS = "structure_id string, part string, pos long, line string"


def shown(path):
    return {f"{os.path.basename(d)}/{f}": open(os.path.join(d, f)).read() for d, _, names in os.walk(path) for f in names if f != "_SUCCESS" and not f.endswith(".crc")}


def test_targets_are_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "targets")
    rows = [("a/b", "hits", 2, "second"), ("a/b", "hits", 1, "first"), ("a/b", "matrix", 1, "1,0"), ("c", "hits", 1, None), ("c", "hits", 2, "x"), (None, "hits", 1, "y")]
    formats.save_targets(spark.createDataFrame(rows, ROWS).repartition(4), path)
    before = {"a%2Fb/hits": "first\nsecond\n", "a%2Fb/matrix": "1,0\n", "c/hits": "x\n"}
    assert shown(path) == before and os.path.exists(f"{path}/_SUCCESS")

    bad = spark.createDataFrame([("c", "hits", 1, "new"), ("d", "hits", 1, "bad")], ROWS).withColumn("line", F.when(F.col("structure_id") == "d", F.raise_error(F.lit("no score")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no score"):
        formats.save_targets(bad, path)
    assert shown(path) == before and not [f for f in os.listdir(path) if f.startswith("_writing")]

    with pytest.raises(Exception, match="there already"):
        formats.save_targets(spark.createDataFrame([("c", "hits", 1, "new"), ("e", "hits", 1, "new")], ROWS), path, overwrite=False)
    assert shown(path) == before
    formats.save_targets(spark.createDataFrame([("c", "list", 1, "new")], ROWS), path)
    assert shown(path) == {k: v for k, v in before.items() if k[0] == "a"} | {"c/list": "new\n"}
    formats.save_targets(spark.createDataFrame([], ROWS), path)
    assert len(shown(path)) == 3


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "targets")
    many = spark.range(2000).select(F.concat(F.lit("t"), (F.col("id") % 40).cast("string")).alias("structure_id"), F.lit("hits").alias("part"), F.col("id").alias("pos"), F.col("id").cast("string").alias("line"))
    writer = formats.TargetWriter(path, True)
    done = writer.write(iter(many.filter("structure_id = 't1'").sort("pos").collect()))
    assert done.targets == ["t1"] and not os.path.exists(f"{path}/t1")  # not before all tasks have ended
    writer.abort([done, None])
    assert shown(path) == {}
    twice = [writer.write(iter(many.filter("structure_id = 't1'").collect())) for _ in range(2)]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit(twice)
    assert shown(path) == {}
