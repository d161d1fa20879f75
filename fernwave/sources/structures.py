"""Fixed-column structure files: text in, nodes out, and scores written back into the same columns.

`atoms` is (structure_id, line_no, record, serial, atom, altloc, resname, chain, resseq, icode, x, y, z, occupancy,
bfactor, line). Line numbers are places in one file, so files are read a row each and split there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import S

# Three-letter residue names that count as amino acids, modified ones included.
AMINO = tuple("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE SEC PYL SEP TPO PTR CSO HYP MLY KCX".split())
# Solvent, ions and buffer molecules, which are never a ligand.
SOLVENT = ("HOH", "WAT", "DOD")
IONS = tuple("MG MN ZN CA NA K CL FE CU NI CO CD SO4 PO4 NO3 CO3 FMT GOL EDO PEG ACT DMS".split())
# Cofactors, which mark an active site and are no ligand of their own; the last line are analogues of
# transition states.
COFACTORS = tuple("GDP GTP GNP GSP GCP ADP ATP ANP ACP AGS NAD NAP FAD FMN SAM SAH HEM COA".split()) + tuple("VO4 BEF ALF MGF AF3 POP PPV".split())


def read_atoms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Atoms of the first model of every file; the structure is named by a folder structure_id=..., else by the file, without its ending."""
    folder, name = (F.regexp_extract(F.input_file_name(), p, 1) for p in (rf"/{S}=([^/]+)/", r"([^/]+?)(\.\w+)?$"))
    files = spark.read.text(paths, wholetext=True).select(F.when(folder != "", folder).otherwise(name).alias(S), F.col("value"))
    return parse_atoms(files.select(S, F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")))


def parse_atoms(lines: DataFrame) -> DataFrame:
    """Atoms from (structure_id, line_no, line)."""
    cut = lambda a, b: F.trim(F.substring("line", a, b - a + 1))
    num = lambda a, b: cut(a, b).try_cast("double")
    first_end = lines.filter(cut(1, 6) == "ENDMDL").groupBy(S).agg(F.min("line_no").alias("_end"))
    atoms = lines.filter(cut(1, 6).isin("ATOM", "HETATM")).join(F.broadcast(first_end), S, "left").filter(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    return atoms.select(
        S, "line_no", cut(1, 6).alias("record"), cut(7, 11).try_cast("int").alias("serial"), cut(13, 16).alias("atom"), cut(17, 17).alias("altloc"), cut(18, 20).alias("resname"),
        cut(22, 22).alias("chain"), cut(23, 26).try_cast("int").alias("resseq"), cut(27, 27).alias("icode"), num(31, 38).alias("x"), num(39, 46).alias("y"), num(47, 54).alias("z"),
        F.coalesce(num(55, 60), F.lit(0.0)).alias("occupancy"), num(61, 66).alias("bfactor"), "line",
    )


def format_atoms(atoms: DataFrame) -> DataFrame:
    """(structure_id, line_no, line): atoms in fixed columns, as `parse_atoms` reads them."""
    right = lambda c, n: F.lpad(c.cast("string"), n, " ")
    number = lambda c, n, digits: F.lpad(F.format_string(f"%.{digits}f", c), n, " ")
    parts = [
        F.rpad("record", 6, " "), right(F.col("serial"), 5), F.lit(" "), F.rpad(F.concat(F.lit(" "), F.col("atom")), 4, " "), F.rpad("altloc", 1, " "), right(F.col("resname"), 3), F.lit(" "),
        F.rpad("chain", 1, " "), right(F.col("resseq"), 4), F.rpad("icode", 1, " "), F.lit("   "), *[number(F.col(c), 8, 3) for c in "xyz"], number(F.col("occupancy"), 6, 2), number(F.col("bfactor"), 6, 2),
    ]
    return atoms.select(S, "line_no", F.concat(*parts).alias("line"))


def write_structures(lines: DataFrame, path: str) -> None:
    """A text file for each structure of (structure_id, line_no, line), in the folder `path`/structure_id=...; a structure is one row."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    whole = lines.groupBy(S).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("value"))
    whole.write.mode("overwrite").partitionBy(S).text(path)


def required(found: DataFrame, wanted: DataFrame, message: str) -> DataFrame:
    """`found`, or an error that names the first of the wanted structures (structure_id) for which it has no row."""
    lacking = wanted.select(S).distinct().join(found.select(S).distinct(), S, "left_anti")
    failed = F.raise_error(F.concat(F.lit(message + " in "), F.col(S)))
    return found.unionByName(lacking.select(*[failed.cast(f.dataType).alias(f.name) for f in found.schema.fields]))


def load_apo(atoms: DataFrame, chain: str | None = "largest", domains: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The nodes of every structure; one without any is an error."""
    return required(load_nodes(atoms, chain, domains), atoms, f"no CA nodes (chain {chain})")


def load_ligand(atoms: DataFrame, code: str | None = None) -> DataFrame:
    """The ligand of every structure; one without any is an error."""
    return required(choose_ligand(atoms, code), atoms, "no ligand")


def best_altloc(atoms: DataFrame) -> DataFrame:
    """One position for each atom of a residue: the highest occupancy, then the lowest serial."""
    w = Window.partitionBy(S, "chain", "resseq", "icode", "resname", "atom").orderBy(F.desc("occupancy"), "serial", "line_no")
    return atoms.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def load_nodes(atoms: DataFrame, chain: str | None = "largest", domains: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """CA nodes, numbered from 0 in file order. `chain`: all (or None), largest (ties: first in the file), or an id."""
    ca = best_altloc(atoms.filter(F.col("resname").isin(*AMINO) & (F.col("atom") == "CA")))
    if chain == "largest":
        per = ca.groupBy(S, "chain").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
        w = Window.partitionBy(S).orderBy(F.desc("n"), "first")
        keep = per.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(S, "chain")
        ca = ca.join(F.broadcast(keep), [S, "chain"], "left_semi")
    elif chain not in (None, "all"):
        ca = ca.filter(F.col("chain") == chain)
    for c, (lo, hi) in (domains or {}).items():
        ca = ca.filter((F.col("chain") != c) | F.col("resseq").between(lo, hi))
    w = Window.partitionBy(S).orderBy("line_no")
    return ca.select(S, (F.row_number().over(w) - 1).cast("long").alias("node_id"), "chain", "resseq", "icode", "resname", "x", "y", "z")


def hetero(atoms: DataFrame) -> DataFrame:
    """(structure_id, resname, n_atoms) of what is neither amino acid nor solvent."""
    h = atoms.filter((F.col("record") == "HETATM") & ~F.col("resname").isin(*AMINO, *SOLVENT))
    return h.groupBy(S, "resname").agg(F.count(F.lit(1)).alias("n_atoms"))


def choose_ligand(atoms: DataFrame, code: str | None = None) -> DataFrame:
    """(structure_id, resname): the given code, or the one with most atoms that is no ion or cofactor (ties: by name)."""
    h = hetero(atoms)
    if code:
        return h.filter(F.col("resname") == code).select(S, "resname")
    w = Window.partitionBy(S).orderBy(F.desc("n_atoms"), "resname")
    return h.filter(~F.col("resname").isin(*IONS, *COFACTORS)).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(S, "resname")



def pocket(holo: DataFrame, ligand: DataFrame, contact: float = 5.0) -> DataFrame:
    """Residues with an atom near one of the ligand's; a ligand has tens of atoms, so these meet within a structure."""
    lig = holo.join(F.broadcast(ligand), [S, "resname"], "left_semi").filter("record = 'HETATM'").select(S, "x", "y", "z")
    res = holo.filter(F.col("resname").isin(*AMINO)).alias("a")
    return res.join(lig.alias("b"), (F.col("a.structure_id") == F.col("b.structure_id")) & (F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) + F.pow(F.col("a.z") - F.col("b.z"), 2) <= contact * contact), "left_semi").select(S, "chain", "resseq", "icode").distinct()


def label_nodes(nodes: DataFrame, pocket_residues: DataFrame) -> DataFrame:
    """Adds y01: whether a node's (resseq, icode) is in the pocket's dominant chain (most residues; ties: by name)."""
    per = pocket_residues.groupBy(S, "chain").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(S).orderBy(F.desc("n"), "chain")
    main = per.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(S, "chain")
    hit = pocket_residues.join(main, [S, "chain"], "left_semi").select(S, "resseq", "icode").distinct().withColumn("_hit", F.lit(1))
    return nodes.join(hit, [S, "resseq", "icode"], "left").withColumn("y01", F.coalesce("_hit", F.lit(0))).drop("_hit")


def cofactor_atoms(raw: DataFrame, codes: tuple[str, ...] = COFACTORS) -> DataFrame:
    return raw.filter((F.col("record") == "HETATM") & F.col("resname").isin(*codes))


def active_site(nodes: DataFrame, raw: DataFrame, near: float = 6.0, codes: tuple[str, ...] = COFACTORS) -> DataFrame:
    """(structure_id, node_id) near an atom of any cofactor of the raw file; cofactors have tens of atoms."""
    atoms = cofactor_atoms(raw, codes).select(S, F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    d2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("z") - F.col("cz"), 2)
    return nodes.join(atoms, S).filter(d2 <= near * near).select(S, "node_id").distinct()


def first_cofactor(raw: DataFrame, codes: tuple[str, ...] = COFACTORS) -> DataFrame:
    """(structure_id, cofactor): the code that comes first in the raw file."""
    return cofactor_atoms(raw, codes).groupBy(S).agg(F.min_by("resname", "line_no").alias("cofactor"))


def bfactor_lines(atoms: DataFrame, nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(structure_id, line_no, line) with columns 61-66 set to each residue's score, scaled to 0-100; 0 where it has none."""
    w = Window.partitionBy(S)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    scaled = scores.select(S, "node_id", F.when(hi > lo, 100.0 * (F.col("score") - lo) / (hi - lo)).otherwise(0.0).alias("b"))
    by = nodes.join(scaled, [S, "node_id"]).groupBy(S, "chain", "resseq").agg(F.max("b").alias("b"))
    value = F.lpad(F.format_string("%.2f", F.coalesce("b", F.lit(0.0))), 6, " ")
    line = F.concat(F.rpad(F.substring("line", 1, 60), 60, " "), value, F.substring("line", 67, 1000))
    return atoms.join(by, [S, "chain", "resseq"], "left").select(S, "line_no", line.alias("line"))


def select_script(ranked: DataFrame, nodes: DataFrame, top: int = 5) -> DataFrame:
    """(structure_id, script): a viewer's selection of the top residues."""
    x = ranked.filter(F.col("pos") <= top).join(nodes, [S, "node_id"])
    one = F.concat(F.lit("(chain "), F.col("chain"), F.lit(" and resi "), F.col("resseq").cast("string"), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("pos", one.alias("s"))))
    return x.groupBy(S).agg(F.concat(F.lit("select top, "), F.array_join(F.transform(rows, lambda r: r["s"]), " or ")).alias("script"))


def raw_files(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `raw`: the file (of column `path`) named by a target's name up to its first underscore; null if there is none."""
    named = files.select("path", F.regexp_extract("path", r"([^/]+?)(\.\w+)?$", 1).alias("_code"))
    return targets.withColumn("_code", F.substring_index("name", "_", 1)).join(named, "_code", "left").drop("_code").withColumnRenamed("path", "raw")


def resolve_active(nodes: DataFrame, spec: DataFrame) -> DataFrame:
    """(structure_id, node_id) named by rows (structure_id, chain, resseq); a null chain stands for every chain."""
    s = spec.select(F.col(S).alias("_s"), F.col("chain").alias("_c"), F.col("resseq").alias("_r"))
    hit = (nodes[S] == s["_s"]) & (nodes["resseq"] == s["_r"]) & (s["_c"].isNull() | (nodes["chain"] == s["_c"]))
    return nodes.join(s, hit, "left_semi").select(S, "node_id")


def all_targets(targets: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Targets (name, apo, holo, ...) with the extra ones, if there are any; columns that one side lacks are null."""
    return targets if extra is None else targets.unionByName(extra, allowMissingColumns=True)


def labelled_targets(targets: DataFrame, labelled: bool = True) -> DataFrame:
    """The targets with a holo structure, to learn and score on; or those without one, to predict."""
    has = F.col("holo").isNotNull() & (F.col("holo") != "")
    return targets.filter(has if labelled else ~has)


def named_targets(targets: DataFrame, names: list[str]) -> DataFrame:
    """The targets whose name starts with one of the given ones; all if none are given."""
    keep = F.lit(not names)
    for n in names:
        keep = keep | F.col("name").startswith(n)
    return targets.filter(keep)
