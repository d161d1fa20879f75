import pytest

from fernwave.sources import sinks, structures
from fernwave.streaming import ingest


def atom(record, serial, name, res, chain, seq, x, y=0.0, z=0.0, alt=" ", icode=" ", occ=1.0):
    return f"{record:<6}{serial:>5} {name:^4}{alt}{res:>3} {chain}{seq:>4}{icode}   {x:>8.3f}{y:>8.3f}{z:>8.3f}{occ:>6.2f}{10.0:>6.2f}          {name[0]:>2}"


LINES = [
    "HEADER    TEST",
    atom("ATOM", 1, "CA", "ALA", "B", 1, 0.0), atom("ATOM", 2, "CA", "GLY", "B", 2, 4.0),
    atom("ATOM", 3, "N", "ALA", "A", 1, 0.0), atom("ATOM", 4, "CA", "ALA", "A", 1, 0.0),
    atom("ATOM", 5, "CA", "SER", "A", 2, 4.0, alt="A", occ=0.4), atom("ATOM", 6, "CA", "SER", "A", 2, 5.0, alt="B", occ=0.6),
    atom("ATOM", 7, "CA", "TRP", "A", 2, 8.0, icode="A"), atom("HETATM", 8, "CA", "MSE", "A", 3, 12.0), atom("HETATM", 9, "CA", "CA", "A", 90, 1.0),
    atom("HETATM", 10, "O", "HOH", "A", 91, 0.0), atom("HETATM", 11, "C1", "LIG", "A", 92, 13.0), atom("HETATM", 12, "C2", "LIG", "A", 92, 14.0),
    atom("HETATM", 13, "MG", "MG", "A", 93, 3.0), atom("HETATM", 14, "P", "GDP", "A", 94, 1.0), atom("HETATM", 15, "P", "DG", "A", 95, 1.0),
    "ENDMDL", atom("ATOM", 99, "CA", "ALA", "A", 99, 99.0),
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "one.pdb").write_text("\n".join(LINES))
    return d


def test_nodes_ligand_pocket_and_active_site(spark, files):
    atoms = structures.read_atoms(spark, str(files)).cache()
    nodes = structures.load_nodes(atoms)
    got = [(r.node_id, r.chain, r.resseq, r.icode, r.resname, r.x) for r in nodes.orderBy("node_id").collect()]
    assert got == [(0, "A", 1, "", "ALA", 0.0), (1, "A", 2, "", "SER", 5.0), (2, "A", 2, "A", "TRP", 8.0), (3, "A", 3, "", "MSE", 12.0)]
    assert structures.load_nodes(atoms, "all").count() == 6 and structures.load_nodes(atoms, "B").count() == 2
    assert structures.load_nodes(atoms, "A", {"A": (2, 2)}).count() == 2
    lig = structures.choose_ligand(atoms)
    assert lig.first().resname == "LIG" and structures.choose_ligand(atoms, "GDP").first().resname == "GDP"
    pocket = structures.pocket(atoms, lig)
    assert sorted((r.resseq, r.icode) for r in pocket.collect()) == [(2, "A"), (3, "")]  # 5.0 itself is a contact
    assert {r.node_id: r.y01 for r in structures.label_nodes(nodes, pocket).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    assert sorted(r.node_id for r in structures.active_site(nodes, atoms).collect()) == [0, 1]
    scores = nodes.selectExpr("structure_id", "node_id", "cast(node_id as double) score")
    lines = {r.line_no: r.line for r in structures.bfactor_lines(atoms, nodes, scores).collect()}
    assert lines[4][60:66] == "  0.00" and lines[8][60:66] == "100.00" and lines[1][60:66] == "  0.00" and lines[8][:60] == LINES[8][:60]


def test_leaderboard_unites_unequal_columns(spark, tmp_path):
    a = spark.createDataFrame([("e1", "s", 0.5, 1)], "exp string, structure_id string, roc_auc double, hit_5 int")
    b = spark.createDataFrame([("e1", "t", 0.7, "n")], "exp string, structure_id string, roc_auc double, note string")
    board = sinks.leaderboard([a, b])
    assert board.columns == ["exp", "structure_id", "hit_5", "note", "roc_auc"]
    m = sinks.leaderboard_means(board).first()
    assert abs(m.mean_auc - 0.6) < 1e-12 and m.hits_5 == 1
    sinks.write_run(str(tmp_path / "run"), a, board)
    assert spark.read.option("header", True).csv(str(tmp_path / "run/leaderboard")).count() == 2


def test_files_as_a_stream(spark, files, tmp_path):
    q = ingest.rank_arrivals(spark, str(files), str(tmp_path / "out"), str(tmp_path / "ck"), top=2)
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.pos for r in rows) == [1, 2] and {r.structure_id for r in rows} == {"one"}


def test_structures_without_nodes_or_ligand_are_an_error(spark, files):
    atoms = structures.read_atoms(spark, str(files))
    assert structures.load_apo(atoms).count() == 4 and structures.load_ligand(atoms).count() == 1
    with pytest.raises(Exception, match="no CA nodes"):
        structures.load_apo(atoms, "Z").collect()
    with pytest.raises(Exception, match="no ligand"):
        structures.load_ligand(atoms.filter("resname NOT IN ('LIG', 'DG')")).collect()


def test_active_sites_take_atoms_of_every_cofactor(spark, files):
    atoms = structures.read_atoms(spark, str(files))
    more = spark.createDataFrame([("one", 99, "HETATM", 99, "V", "", "VO4", "A", 99, "", 13.0, 0.0, 0.0, 1.0, 0.0, "")], atoms.schema)
    nodes = structures.load_nodes(atoms)
    assert sorted(r.node_id for r in structures.active_site(nodes, atoms.unionByName(more)).collect()) == [0, 1, 2, 3]
    assert structures.first_cofactor(atoms.unionByName(more)).first().cofactor == "GDP"


def test_lines_survive_writing_and_reading(spark, files, tmp_path):
    atoms = structures.read_atoms(spark, str(files))
    structures.write_structures(structures.format_atoms(atoms), str(tmp_path / "w"))
    again = structures.read_atoms(spark, str(tmp_path / "w/*"))
    keep = ["structure_id", "record", "serial", "atom", "altloc", "resname", "chain", "resseq", "icode", "x", "y", "z", "occupancy"]
    assert sorted(map(tuple, again.select(*keep).collect())) == sorted(map(tuple, atoms.select(*keep).collect()))


def test_targets(spark):
    t = spark.createDataFrame([("A_1", "a", "h"), ("B_1", "b", None)], "name string, apo string, holo string")
    every = structures.all_targets(t, spark.createDataFrame([("C_1", "c")], "name string, apo string"))
    assert [sorted(r.name for r in structures.labelled_targets(every, k).collect()) for k in (True, False)] == [["A_1"], ["B_1", "C_1"]]
    assert sorted(r.name for r in structures.named_targets(every, ["B", "C"]).collect()) == ["B_1", "C_1"] and structures.named_targets(every, []).count() == 3
