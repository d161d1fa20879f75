"""Queries over structure files and written results: fixed-column files are made from the point table, written, read
back and loaded; results are written by the sinks and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import circuits, graph, learned, ranking
from ..operators.graph import S
from ..sources import formats, sinks, structures
from ..sources.points import embedding_nodes
from .catalogue import AUCS, CH, KNN, NODES, ORDER, _aucs, _ordered, query, whole, whole_structures, with_
from .spectra import paths

RES = structures.AMINO[:20]


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def made_atoms(spark, sf_dir) -> DataFrame:
    """Atoms of a structure for each label: a residue for each point, with alternate places, insertion codes, modified
    residues, water, ions, ligands, cofactors and nucleic acid by point number, and a second model."""
    n = embedding_nodes(spark, sf_dir, by_label=True)
    rn = F.row_number().over(Window.partitionBy(S).orderBy("node_id"))
    n = n.select(S, "node_id", "x", "y", "z", (F.pmod(rn - 1, F.lit(9999)) + 1).cast("int").alias("q"), rn.cast("long").alias("rn"))
    every = lambda k: F.col("node_id") % k == 0
    names = F.array(*[F.lit(r) for r in RES])
    modified = every(19)
    res = F.when(modified, "MSE").otherwise(F.get(names, (F.col("node_id") % 20).cast("int")))
    chain = F.when(F.col("rn") % 3 == 1, "B").otherwise("A")
    icode = F.when(every(13), "A").otherwise("")

    def atom(slot, record, name, alt, resname, chain_, icode_, dx, occ):
        return F.struct(
            F.lit(slot).alias("slot"), record.alias("record"), F.lit(name).alias("atom"), F.lit(alt).alias("altloc"), resname.alias("resname"), chain_.alias("chain"), icode_.alias("icode"),
            (F.col("x") + dx).alias("x"), F.lit(occ).alias("occupancy"),
        )

    lit = F.lit
    own = F.when(modified, "HETATM").otherwise("ATOM")
    some = [
        F.array(atom(0, own, "N", "", res, chain, icode, 0.5, 1.0)),
        F.when(every(11), F.array(atom(1, own, "CA", "A", res, chain, icode, 1.0, 0.4), atom(2, own, "CA", "B", res, chain, icode, 0.0, 0.6))).otherwise(F.array(atom(1, own, "CA", "", res, chain, icode, 0.0, 1.0))),
        F.when(every(17), F.array(atom(3, lit("HETATM"), "O", "", lit("HOH"), lit("W"), lit(""), 0.0, 1.0))),
        F.when(every(23), F.array(atom(4, lit("HETATM"), "C1", "", F.when(every(46), "LIG").otherwise("DRG"), lit("L"), lit(""), 2.0, 1.0))),
        F.when(every(29), F.array(atom(5, lit("HETATM"), "MG", "", lit("MG"), lit("I"), lit(""), 0.0, 1.0))),
        F.when(every(31), F.array(atom(6, lit("HETATM"), "P", "", lit("GDP"), lit("C"), lit(""), 1.5, 1.0))),
        F.when(every(37), F.array(atom(7, lit("HETATM"), "V", "", lit("VO4"), lit("C"), lit(""), 1.5, 1.0))),
        F.when(every(41), F.array(atom(8, lit("ATOM"), "P", "", lit("DG"), lit("D"), lit(""), 0.0, 1.0))),
    ]
    flat = F.filter(F.flatten(F.array(*some[:2], *[F.coalesce(s, F.array().cast(s_type)) for s, s_type in zip(some[2:], ["array<struct<slot:int,record:string,atom:string,altloc:string,resname:string,chain:string,icode:string,x:double,occupancy:double>>"] * 6)])), lambda a: a["slot"] >= 0)
    one = n.select(S, "rn", "q", "y", "z", F.explode(flat).alias("a"))
    return one.select(
        S, (F.col("rn") * 10 + F.col("a.slot")).alias("line_no"), "a.record", F.col("q").alias("serial"), "a.atom", "a.altloc", "a.resname", "a.chain", F.col("q").alias("resseq"), "a.icode", "a.x", "y", "z",
        "a.occupancy", F.lit(10.0).alias("bfactor"),
    )


def _written(spark, sf_dir) -> str:
    """The folder of the made structures' files, in the shared folder. A second model follows each one's end."""
    lines = structures.format_atoms(made_atoms(spark, sf_dir))
    last = lines.groupBy(S).agg((F.max("line_no") + 1).alias("end"), F.min_by("line", "line_no").alias("line"))
    more = last.select(S, F.col("end").alias("line_no"), F.lit("ENDMDL").alias("line")).unionByName(last.select(S, (F.col("end") + 1).alias("line_no"), "line"))
    path = _fresh(spark, "structures")
    structures.write_structures(lines.unionByName(more), path)
    return path


def _files(spark, sf_dir) -> DataFrame:
    """The made structures as files, read back."""
    return structures.read_atoms(spark, f"{_written(spark, sf_dir)}/*")


MADE = (
    NODES
    + """,
rs AS (SELECT CAST(label AS VARCHAR) AS s, node_id AS id, x, y, z, row_number() OVER (PARTITION BY label ORDER BY node_id) AS rn FROM nodes),
rr AS (SELECT *, CAST((rn - 1) % 9999 + 1 AS INTEGER) AS q, CASE WHEN rn % 3 = 1 THEN 'B' ELSE 'A' END AS ch, CASE WHEN id % 13 = 0 THEN 'A' ELSE '' END AS ic,
  CASE WHEN id % 19 = 0 THEN 'HETATM' ELSE 'ATOM' END AS own, CASE WHEN id % 19 = 0 THEN 'MSE' ELSE [RES][id % 20 + 1] END AS res FROM rs),
at0 AS (SELECT s, rn, q, y, z, 0 AS slot, own AS record, 'N' AS atom, '' AS altloc, res AS resname, ch AS chain, ic AS icode, x + 0.5::DOUBLE AS x, 1.0::DOUBLE AS occupancy FROM rr
  UNION ALL SELECT s, rn, q, y, z, 1, own, 'CA', CASE WHEN id % 11 = 0 THEN 'A' ELSE '' END, res, ch, ic, x + CASE WHEN id % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN id % 11 = 0 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END FROM rr
  UNION ALL SELECT s, rn, q, y, z, 2, own, 'CA', 'B', res, ch, ic, x, 0.6::DOUBLE FROM rr WHERE id % 11 = 0
  UNION ALL SELECT s, rn, q, y, z, 3, 'HETATM', 'O', '', 'HOH', 'W', '', x, 1.0::DOUBLE FROM rr WHERE id % 17 = 0
  UNION ALL SELECT s, rn, q, y, z, 4, 'HETATM', 'C1', '', CASE WHEN id % 46 = 0 THEN 'LIG' ELSE 'DRG' END, 'L', '', x + 2.0::DOUBLE, 1.0::DOUBLE FROM rr WHERE id % 23 = 0
  UNION ALL SELECT s, rn, q, y, z, 5, 'HETATM', 'MG', '', 'MG', 'I', '', x, 1.0::DOUBLE FROM rr WHERE id % 29 = 0
  UNION ALL SELECT s, rn, q, y, z, 6, 'HETATM', 'P', '', 'GDP', 'C', '', x + 1.5::DOUBLE, 1.0::DOUBLE FROM rr WHERE id % 31 = 0
  UNION ALL SELECT s, rn, q, y, z, 7, 'HETATM', 'V', '', 'VO4', 'C', '', x + 1.5::DOUBLE, 1.0::DOUBLE FROM rr WHERE id % 37 = 0
  UNION ALL SELECT s, rn, q, y, z, 8, 'ATOM', 'P', '', 'DG', 'D', '', x, 1.0::DOUBLE FROM rr WHERE id % 41 = 0),
atoms AS (SELECT s AS structure_id, row_number() OVER (PARTITION BY s ORDER BY rn, slot) - 1 AS line_no, record, q AS serial, atom, altloc, resname, chain, q AS resseq, icode, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, occupancy FROM at0),
amino AS (SELECT * FROM atoms WHERE record = 'ATOM' AND resname <> 'DG' OR resname = 'MSE'),
ca AS (SELECT * FROM amino WHERE atom = 'CA' AND altloc <> 'A'),
nd AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY line_no) - 1 AS node_id FROM ca WHERE chain = 'A')""".replace("[RES]", "[" + ", ".join(f"'{r}'" for r in RES) + "]")
)


@query(with_(MADE, "SELECT structure_id, CAST(line_no AS INTEGER) AS line_no, record, serial, atom, altloc, resname, chain, resseq, icode, x, y, z, occupancy FROM atoms"))
def file_atoms(spark, sf_dir):
    return _files(spark, sf_dir).drop("line", "bfactor")


_NODE_COLUMNS = [S, "node_id", "chain", "resseq", "icode", "resname", "x", "y", "z"]


@query(with_(MADE, "SELECT structure_id, node_id, chain, resseq, icode, resname, x, y, z FROM nd"))
def file_nodes_largest(spark, sf_dir):
    return structures.load_apo(_files(spark, sf_dir)).select(*_NODE_COLUMNS)


@query(with_(MADE, "SELECT structure_id, row_number() OVER (PARTITION BY structure_id ORDER BY line_no) - 1 AS node_id, chain, resseq, icode, resname, x, y, z FROM ca WHERE chain <> 'A' OR resseq BETWEEN 5 AND 20"))
def file_nodes_domain(spark, sf_dir):
    return structures.load_apo(_files(spark, sf_dir), "all", {"A": (5, 20)}).select(*_NODE_COLUMNS)


@query(with_(MADE, "SELECT structure_id, chain, count(*) AS residues FROM ca GROUP BY 1, 2"))
def file_chain_residues(spark, sf_dir):
    return structures.load_nodes(_files(spark, sf_dir), None).groupBy(S, "chain").agg(F.count(F.lit(1)).alias("residues"))


@query(with_(MADE, "SELECT structure_id, chain, resseq, icode, atom, altloc, occupancy, x FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, chain, resseq, icode, resname, atom ORDER BY occupancy DESC, serial, line_no) AS r FROM amino) WHERE r = 1"))
def file_altlocs(spark, sf_dir):
    a = _files(spark, sf_dir)
    return structures.best_altloc(a.filter(F.col("resname").isin(*structures.AMINO))).select(S, "chain", "resseq", "icode", "atom", "altloc", "occupancy", "x")


@query(with_(MADE, "SELECT structure_id, resname, count(*) AS n_atoms FROM atoms WHERE record = 'HETATM' AND resname NOT IN ('HOH', 'MSE') GROUP BY 1, 2"))
def file_hetero(spark, sf_dir):
    return structures.hetero(_files(spark, sf_dir))


LIGAND = MADE + ", lg AS (SELECT structure_id, resname FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY n DESC, resname) AS r FROM (SELECT structure_id, resname, count(*) AS n FROM atoms WHERE resname IN ('LIG', 'DRG') GROUP BY 1, 2)) WHERE r = 1)"


@query(with_(LIGAND, "SELECT structure_id, resname FROM lg"))
def file_ligand(spark, sf_dir):
    return structures.choose_ligand(_files(spark, sf_dir))


POCKET = LIGAND + """, pk AS (SELECT DISTINCT a.structure_id, a.chain, a.resseq, a.icode FROM amino a JOIN atoms l ON l.structure_id = a.structure_id JOIN lg ON lg.structure_id = l.structure_id AND lg.resname = l.resname
  WHERE (a.x - l.x) ** 2 + (a.y - l.y) ** 2 + (a.z - l.z) ** 2 <= 25.0),
dom AS (SELECT structure_id, chain FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY n DESC, chain) AS r FROM (SELECT structure_id, chain, count(*) AS n FROM pk GROUP BY 1, 2)) WHERE r = 1)"""


@query(with_(POCKET, "SELECT structure_id, chain, resseq, icode FROM pk"))
def file_pocket(spark, sf_dir):
    a = _files(spark, sf_dir)
    return structures.pocket(a, structures.choose_ligand(a))


@query(with_(POCKET, "SELECT structure_id, node_id, CAST(EXISTS (SELECT 1 FROM pk JOIN dom USING (structure_id, chain) WHERE pk.structure_id = nd.structure_id AND pk.resseq = nd.resseq AND pk.icode = nd.icode) AS INTEGER) AS y01 FROM nd"))
def file_pocket_labels(spark, sf_dir):
    a = _files(spark, sf_dir)
    return structures.label_nodes(structures.load_nodes(a), structures.pocket(a, structures.choose_ligand(a))).select(S, "node_id", "y01")


@query(with_(MADE, "SELECT DISTINCT n.structure_id, n.node_id, c.cofactor FROM nd n JOIN atoms a ON a.structure_id = n.structure_id AND a.resname IN ('GDP', 'VO4') JOIN (SELECT structure_id, arg_min(resname, line_no) AS cofactor FROM atoms WHERE resname IN ('GDP', 'VO4') GROUP BY 1) c ON c.structure_id = n.structure_id WHERE (a.x - n.x) ** 2 + (a.y - n.y) ** 2 + (a.z - n.z) ** 2 <= 36.0"))
def file_active_site(spark, sf_dir):
    a = _files(spark, sf_dir)
    return structures.active_site(structures.load_nodes(a), a).join(structures.first_cofactor(a), S)


@query(with_(MADE, "SELECT structure_id, node_id FROM nd WHERE resseq % 7 = 0 OR resseq % 11 = 0"))
def file_active_spec(spark, sf_dir):
    """Active nodes named by residue: multiples of 7 in any chain, multiples of 11 in chain A; those of 5 in chain B are not loaded."""
    n = structures.load_nodes(_files(spark, sf_dir))
    every = made_atoms(spark, sf_dir).select(S, "resseq").distinct()
    spec = every.filter("resseq % 7 = 0").select(S, F.lit(None).cast("string").alias("chain"), "resseq")
    spec = spec.unionByName(every.filter("resseq % 11 = 0").select(S, F.lit("A").alias("chain"), "resseq")).unionByName(every.filter("resseq % 5 = 0").select(S, F.lit("B").alias("chain"), "resseq"))
    return structures.resolve_active(n, spec)


@query(
    with_(
        MADE,
        """, sc AS (SELECT structure_id, resseq, max(CASE WHEN hi > lo THEN 100.0 * (x - lo) / (hi - lo) ELSE 0.0 END) AS b FROM (SELECT *, min(x) OVER (PARTITION BY structure_id) AS lo, max(x) OVER (PARTITION BY structure_id) AS hi FROM nd) GROUP BY 1, 2)
SELECT a.structure_id, CAST(a.line_no AS INTEGER) AS line_no, a.resname, round(CASE WHEN a.chain = 'A' THEN coalesce(b, 0.0) ELSE 0.0 END, 2) AS b FROM atoms a LEFT JOIN sc ON sc.structure_id = a.structure_id AND sc.resseq = a.resseq""",
    )
)
def file_bfactors(spark, sf_dir):
    """Scores written into the files' B-factor columns, and read from them again."""
    a = _files(spark, sf_dir)
    n = structures.load_nodes(a)
    lines = structures.bfactor_lines(a, n, n.select(S, "node_id", F.col("x").alias("score")))
    path = _fresh(spark, "bfactors")
    structures.write_structures(lines, path)
    return structures.read_atoms(spark, f"{path}/*").select(S, "line_no", "resname", F.round("bfactor", 2).alias("b"))


@query(with_(MADE, "SELECT structure_id, 'select top, ' || string_agg('(chain A and resi ' || resseq || ')', ' or ' ORDER BY pos) AS script FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY x DESC, node_id) AS pos FROM nd) WHERE pos <= 5 GROUP BY 1"))
def file_viewer_script(spark, sf_dir):
    n = structures.load_nodes(_files(spark, sf_dir))
    return structures.select_script(ranking.finalize(n.select(S, "node_id", F.col("x").alias("score"))), n)


_TARGETS = MADE + ", tg AS (SELECT structure_id || '_' || resname AS name, structure_id AS code, CASE WHEN resname = 'LIG' THEN structure_id || '_holo' END AS holo FROM (SELECT DISTINCT structure_id, resname FROM atoms WHERE resname IN ('LIG', 'DRG')))"


def _targets(spark, sf_dir) -> DataFrame:
    """Two tables of targets, one with a holo structure for each and one, extra, without that column."""
    h = structures.hetero(made_atoms(spark, sf_dir)).filter(F.col("resname").isin("LIG", "DRG")).select(F.concat_ws("_", S, "resname").alias("name"), S, "resname")
    base = h.filter("resname = 'LIG'").select("name", F.concat(S, F.lit("_holo")).alias("holo"))
    return structures.all_targets(base, h.filter("resname = 'DRG'").select("name"))


@query(with_(_TARGETS, "SELECT name, 'structure_id=' || code AS raw, holo, holo IS NOT NULL AS labelled FROM tg"))
def file_targets(spark, sf_dir):
    """Targets with the extra ones, their raw files, and whether they can be learned from."""
    t = _targets(spark, sf_dir)
    names = embedding_nodes(spark, sf_dir, by_label=True).select(F.concat(F.lit("/raw/"), S, F.lit(".pdb")).alias("path")).distinct()
    raw = structures.raw_files(t, names)
    both = structures.labelled_targets(raw).withColumn("labelled", F.lit(True)).unionByName(structures.labelled_targets(raw, False).withColumn("labelled", F.lit(False)))
    return both.select("name", F.concat(F.lit("structure_id="), F.regexp_extract("raw", r"([^/]+)\.pdb$", 1)).alias("raw"), "holo", "labelled")


# Sinks: what is written, as it is read back


def _board(spark, sf_dir, whole: bool = False) -> DataFrame:
    """Two frames of unequal columns as one board: the channels' AUC, and hits of one of them."""
    auc = _aucs(spark, sf_dir, whole).select(F.col("channel").alias("exp"), S, F.round("auc", 4).alias("roc_auc"))
    r, _ = _ordered(spark, sf_dir, whole)
    hits = r.filter("pos <= 5").groupBy(S).agg(F.max((F.col("node_id") % 3 == 0).cast("int")).alias("hit_5"))
    with_hits = auc.filter("exp = 'x'").join(hits, S).select("exp", S, "roc_auc", "hit_5")
    return sinks.leaderboard([with_hits, auc.filter("exp <> 'x'")])


_BOARD = ORDER + AUCS.replace(NODES, "") + ", bd AS (SELECT channel AS exp, CAST(auc.label AS VARCHAR) AS structure_id, round(auc, 4) AS roc_auc, CASE WHEN channel = 'x' THEN h END AS hit_5 FROM auc JOIN (SELECT label, max(CAST(node_id % 3 = 0 AS INTEGER)) FILTER (WHERE pos <= 5) AS h FROM o GROUP BY 1) USING (label))"


@query(with_(_BOARD, "SELECT exp, structure_id, hit_5, roc_auc FROM bd"))
def sink_leaderboard(spark, sf_dir):
    path = _fresh(spark, "run")
    r, n = _ordered(spark, sf_dir)
    sinks.write_run(path, ranking.hit_list(r, n), _board(spark, sf_dir))
    return spark.read.option("header", True).schema("exp string, structure_id string, hit_5 int, roc_auc double").csv(f"{path}/leaderboard")


@query(with_(_BOARD, "SELECT exp, round(avg(roc_auc), 6) AS mean_auc, sum(hit_5)::BIGINT AS hits_5 FROM bd GROUP BY exp"))
def sink_leaderboard_means(spark, sf_dir):
    return sinks.leaderboard_means(_board(spark, sf_dir)).withColumn("mean_auc", F.round("mean_auc", 6))


@query(with_(ORDER, "SELECT CAST(label AS VARCHAR) AS structure_id, node_id, CAST(pos AS INTEGER) AS pos, round(x, 6) AS score FROM o WHERE pos <= 5"))
def sink_hits(spark, sf_dir):
    """Hit lists and a matrix, written by structure; the hits as they are read back."""
    path = _fresh(spark, "run")
    r, n = _ordered(spark, sf_dir)
    top = ranking.hit_list(r, n.select(S, "node_id"))
    sinks.write_run(path, top.select(S, "node_id", "pos", F.round("score", 6).alias("score")), _board(spark, sf_dir))
    return spark.read.schema("node_id long, pos int, score double, structure_id string").json(f"{path}/hits").select(S, "node_id", "pos", "score")


@query(whole(with_(KNN, "SELECT CAST(label AS VARCHAR) AS structure_id, i, j, 1.0::DOUBLE AS v FROM knn")))
def sink_matrix(spark, sf_dir):
    path = _fresh(spark, "run")
    r, n = _ordered(spark, sf_dir, whole=True)
    m = graph.hamiltonian(*whole_structures(spark, sf_dir), "adjacency")
    sinks.write_run(path, ranking.hit_list(r, n), _board(spark, sf_dir, whole=True), m)
    return spark.read.schema("i long, j long, v double, structure_id string").parquet(f"{path}/matrix").select(S, "i", "j", "v")


@query(with_(_BOARD, "SELECT structure_id, printf('- **%s**: AUC %s, top 5 hit %d', structure_id, CAST(round(CAST(roc_auc AS DECIMAL(9, 4)), 3) AS DECIMAL(9, 3))::VARCHAR, hit_5) AS line FROM bd WHERE exp = 'x'"))
def sink_report(spark, sf_dir):
    path = _fresh(spark, "report")
    sinks.report_lines(_board(spark, sf_dir).filter("exp = 'x'")).write.partitionBy(S).text(path)
    return spark.read.schema("line string, structure_id string").text(path).select(S, "line")


@query(with_(_BOARD, "SELECT CAST(label AS VARCHAR) AS structure_id, roc_auc AS auc, CAST(pos AS INTEGER) AS pos, node_id, round(x, 6) AS score FROM o JOIN bd ON structure_id = CAST(label AS VARCHAR) AND exp = 'x' WHERE pos <= 5"))
def sink_submission(spark, sf_dir):
    """A document of statistics and hits for each structure, written and parsed again."""
    r, _ = _ordered(spark, sf_dir)
    hits = r.filter("pos <= 5").select(S, "pos", "node_id", F.round("score", 6).alias("score"))
    path = _fresh(spark, "submission")
    sinks.submission_json(hits, _board(spark, sf_dir).filter("exp = 'x'").select(S, F.col("roc_auc").alias("auc"))).select("json").write.text(path)
    doc = spark.read.schema("structure_id string, auc double, hits array<struct<pos:int,node_id:long,score:double>>").json(path)
    return doc.select(S, "auc", F.explode("hits").alias("h")).select(S, "auc", "h.*")


@query(with_(NODES, ", pn AS (SELECT label, node_id, row_number() OVER (PARTITION BY label ORDER BY node_id) - 1 AS r, lead(node_id) OVER (PARTITION BY label ORDER BY node_id) AS nx FROM nodes), e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY node_id) - 1 AS k, r FROM pn WHERE nx IS NOT NULL) SELECT CAST(label AS VARCHAR) AS structure_id, printf('%s q[%d], q[%d] theta=%.6f', g, r, r + 1, 0.5::DOUBLE) AS line, count(*) AS times FROM e, (VALUES ('rxx'), ('ryy')) v(g), range(2) t(step) GROUP BY 1, 2"))
def sink_circuit_text(spark, sf_dir):
    """A walk's gates on each path, as text written and read back; nodes are numbered along the path."""
    n, e = paths(spark, sf_dir)
    number = n.select(S, "node_id", (F.row_number().over(Window.partitionBy(S).orderBy("node_id")) - 1).alias("k"))
    of = lambda c: number.select(S, F.col("node_id").alias(c), F.col("k").alias(f"_{c}"))
    numbered = e.join(of("i"), [S, "i"]).join(of("j"), [S, "j"]).select(S, F.col("_i").cast("long").alias("i"), F.col("_j").cast("long").alias("j"))
    path = _fresh(spark, "circuit")
    circuits.gate_lines(circuits.walk_gates(numbered, 1.0, 2)).select(S, "line").write.partitionBy(S).text(path)
    return spark.read.schema("line string, structure_id string").text(path).groupBy(S, "line").agg(F.count(F.lit(1)).alias("times"))


@query(with_(MADE, "SELECT structure_id, CAST(line_no AS INTEGER) AS line_no, record, serial, atom, altloc, resname, chain, resseq, icode, x, y, z, occupancy FROM atoms"))
def format_atoms(spark, sf_dir):
    """The made files through the reader of structure files."""
    return formats.read_structures(spark, _written(spark, sf_dir)).drop("line", "bfactor")


@query(with_(MADE, "SELECT structure_id, CAST(line_no AS INTEGER) AS line_no, resname, resseq, x, y, z FROM atoms WHERE chain = 'A' AND atom = 'CA' AND resseq >= 10 AND resname IN ('ALA', 'GLY', 'MSE')"))
def format_atoms_filtered(spark, sf_dir):
    """Conditions on chain, atom and residue, which the reader applies."""
    only = {"chain": ["A"], "atom": ["CA"], "resseq": [10, 9999], "resname": ["ALA", "GLY", "MSE"]}
    return formats.read_structures(spark, _written(spark, sf_dir), only=only).select(S, "line_no", "resname", "resseq", "x", "y", "z")


_BOTH = KNN + ORDER[len(NODES) :]


@query(
    with_(
        _BOTH,
        """SELECT CAST(label AS VARCHAR) AS structure_id, 'hits' AS part, CAST(pos AS VARCHAR) || ',' || CAST(node_id AS VARCHAR) AS line FROM o WHERE pos <= 5
UNION ALL SELECT CAST(label AS VARCHAR), 'matrix', CAST(i AS VARCHAR) || ',' || CAST(j AS VARCHAR) FROM knn""",
    )
)
def committed_targets(spark, sf_dir):
    """Hits and matrix of every structure, committed together in its folder, as they are read back."""
    path = _fresh(spark, "targets")
    r, n = _ordered(spark, sf_dir)
    part = lambda rows, name, a, b: rows.select(S, F.lit(name).alias("part"), F.col(a).cast("long").alias("pos"), F.concat_ws(",", a, b).alias("line"))
    formats.save_targets(part(r.filter("pos <= 5"), "hits", "pos", "node_id").unionByName(part(graph.knn_edges(n, 10), "matrix", "i", "j")), path)
    place = lambda k: F.regexp_extract(F.input_file_name(), "/([^/]+)/([^/]+)$", k)
    return spark.read.text(f"{path}/*/*").select(place(1).alias(S), place(2).alias("part"), F.col("value").alias("line"))
