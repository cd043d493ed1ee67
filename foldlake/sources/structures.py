"""Structure texts to residues, as DataFrame expressions over lines.

Input rows are (structure_id, text), one file each.  Output rows are the alpha carbons:
(structure_id, chain, i, seq, x, y, z), i from 0 along each chain, seq the number with its
insertion code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import guess_format, leading_number

# The standard residues.
STANDARD = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()

# Common modified residues and their parents; more may be given as a table.
MODIFIED = {"MSE": "MET", "SEP": "SER", "TPO": "THR", "PTR": "TYR", "CSO": "CYS", "HYP": "PRO", "MLY": "LYS", "M3L": "LYS", "PCA": "GLU", "KCX": "LYS", "CME": "CYS", "CSD": "CYS"}


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, text) of every file under a path."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    return files.select(name.alias("structure_id"), F.col("value").alias("text"))


def _lines(structures: DataFrame) -> DataFrame:
    return structures.select("structure_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Drops a row that repeats the number of the row before in its chain, and numbers the rest."""
    along = Window.partitionBy("structure_id", "chain").orderBy("at")
    kept = rows.withColumn("_same", F.lag("seq").over(along).eqNullSafe(F.col("seq"))).where(~F.col("_same"))
    return kept.select("structure_id", "chain", (F.row_number().over(along) - 1).alias("i"), "seq", "x", "y", "z")


def residues_pdb(structures: DataFrame, modified: DataFrame | None = None) -> DataFrame:
    """Fixed columns; the first model; ATOM of a standard residue, HETATM of one declared or known as modified.

    ``modified`` (residue) replaces the built-in list.  Numbers that can't be read are null.
    """
    lines = _lines(structures)
    cut = lambda a, b: F.trim(F.substring("line", a + 1, b - a))
    record = cut(0, 6)
    whole = Window.partitionBy("structure_id")
    marked = lines.withColumn("record", record).where(F.col("record").isin("ATOM", "HETATM", "ENDMDL", "MODRES"))
    marked = marked.withColumn("_end", F.min(F.when(F.col("record") == "ENDMDL", F.col("at"))).over(whole)).withColumn("_first", F.min(F.when(F.col("record").isin("ATOM", "HETATM"), F.col("at"))).over(whole))
    declared = marked.where((F.col("record") == "MODRES") & (F.col("at") < F.coalesce("_first", F.col("at") + 1)) & cut(24, 27).isin(*STANDARD)).select("structure_id", cut(12, 15).alias("residue"), F.lit(True).alias("_declared")).distinct()
    atoms = marked.where(F.col("record").isin("ATOM", "HETATM") & (cut(12, 16) == "CA") & (F.col("_end").isNull() | (F.col("at") < F.col("_end"))))
    atoms = atoms.select("structure_id", "at", "record", cut(17, 20).alias("residue"), F.substring("line", 22, 1).alias("chain"), cut(22, 27).alias("seq"), *[leading_number(F.substring("line", a, 8)).alias(c) for c, a in zip("xyz", (31, 39, 47), strict=True)])
    atoms = atoms.join(declared, ["structure_id", "residue"], "left")
    if modified is not None:
        atoms = atoms.join(modified.select("residue", F.lit(True).alias("_listed")).distinct(), "residue", "left")
    else:
        atoms = atoms.withColumn("_listed", F.col("residue").isin(*MODIFIED))
    ok = F.when(F.col("record") == "ATOM", F.col("residue").isin(*STANDARD)).otherwise(F.coalesce("_declared", F.lit(False)) | F.coalesce("_listed", F.lit(False)))
    return _numbered(atoms.where(ok))


TOKEN = r"""'[^']*'|"[^"]*"|\S+"""


def cif_tokens(line: Column) -> Column:
    """Values of a row: quotes open only where a value begins, and are dropped."""
    raw = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))
    quoted = lambda t: (F.length(t) >= 2) & (F.substring(t, 1, 1).isin("'", '"')) & (F.substring(t, 1, 1) == F.substring(t, -1, 1))
    return F.transform(raw, lambda t: F.when(quoted(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))


def cif_loop(structures: DataFrame, category: str) -> DataFrame:
    """Rows of the first loop of a category: (structure_id, at, fields), a map of column name to value."""
    lines = _lines(structures)
    text = F.trim("line")
    head = lines.where(text.startswith(f"{category}."))
    along = Window.partitionBy("structure_id").orderBy("at")
    head = head.withColumn("_k", F.row_number().over(along)).withColumn("_start", F.first("at").over(along))
    head = head.where(F.col("at") - F.col("_k") + 1 == F.col("_start"))
    name = F.substring(text, F.lit(len(category) + 2), F.length(text))
    heads = head.groupBy("structure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.trim(name).alias("n")))), lambda s: s["n"]).alias("names"), F.max("at").alias("_last"))
    body = lines.join(heads, "structure_id").where(F.col("at") > F.col("_last"))
    stop = text.startswith("#") | text.startswith("_") | text.startswith("loop_") | text.startswith("data_")
    body = body.withColumn("_stop", F.min(F.when(stop, F.col("at"))).over(Window.partitionBy("structure_id"))).where((F.col("_stop").isNull() | (F.col("at") < F.col("_stop"))) & (text != ""))
    values = body.select("structure_id", "at", "names", cif_tokens(F.col("line")).alias("v"))
    fields = F.when(F.size("v") == F.size("names"), F.map_from_arrays("names", "v"))
    return values.select("structure_id", "at", fields.alias("fields")).where("fields is not null")


def residues_mmcif(structures: DataFrame, modified: DataFrame | None = None) -> DataFrame:
    """The first model of the _atom_site loop; ATOM of any residue, HETATM of a modified one with a sequence number.

    Alternate locations other than '.', '?' and A are left out.  The chain is the author's, or
    else the label's.
    """
    rows = cif_loop(structures, "_atom_site")
    get = lambda n: F.try_element_at("fields", F.lit(n))
    rows = rows.select(
        "structure_id", "at", get("group_PDB").alias("record"), get("label_atom_id").alias("atom"), get("label_comp_id").alias("residue"), get("label_seq_id").alias("label_seq"),
        F.coalesce(get("label_alt_id"), F.lit(".")).alias("alt"), F.coalesce(get("auth_asym_id"), get("label_asym_id")).alias("chain"), F.coalesce(get("pdbx_PDB_model_num"), F.lit("1")).alias("model"),
        F.concat(F.coalesce(get("auth_seq_id"), get("label_seq_id")), F.when(F.coalesce(get("pdbx_PDB_ins_code"), F.lit("?")).isin(".", "?"), "").otherwise(get("pdbx_PDB_ins_code"))).alias("seq"),
        *[leading_number(get(f"Cartn_{c}")).alias(c) for c in "xyz"],
    )
    whole = Window.partitionBy("structure_id")
    rows = rows.withColumn("_model", F.min_by("model", "at").over(whole))
    rows = rows.withColumn("_other", F.min(F.when(F.col("model") != F.col("_model"), F.col("at"))).over(whole)).where(F.col("_other").isNull() | (F.col("at") < F.col("_other")))
    declared = cif_loop(structures, "_pdbx_struct_mod_residue").select("structure_id", get("label_comp_id").alias("residue"), get("parent_comp_id").alias("parent")).where(F.col("parent").isin(*STANDARD))
    atoms = rows.where((F.col("atom") == "CA") & F.col("alt").isin(".", "?", "A"))
    atoms = atoms.join(declared.select("structure_id", "residue", F.lit(True).alias("_declared")).distinct(), ["structure_id", "residue"], "left")
    if modified is not None:
        atoms = atoms.join(modified.select("residue", F.lit(True).alias("_listed")).distinct(), "residue", "left")
    else:
        atoms = atoms.withColumn("_listed", F.col("residue").isin(*MODIFIED))
    hetero = ~F.col("label_seq").isin(".", "?") & (F.coalesce("_declared", F.lit(False)) | F.coalesce("_listed", F.lit(False)))
    return _numbered(atoms.where((F.col("record") == "ATOM") | ((F.col("record") == "HETATM") & hetero)))


def residues_xyz(structures: DataFrame) -> DataFrame:
    """Three numbers a line; blank lines are passed over. One chain, named by a blank."""
    rows = _lines(structures).where(F.trim("line") != "").withColumn("v", F.split(F.trim("line"), r"\s+"))
    along = Window.partitionBy("structure_id").orderBy("at")
    i = F.row_number().over(along) - 1
    return rows.select("structure_id", F.lit(" ").alias("chain"), i.alias("i"), (i + 1).cast("string").alias("seq"), *[leading_number(F.get("v", F.lit(k))).alias(c) for k, c in enumerate("xyz")])


def residues(structures: DataFrame) -> DataFrame:
    """Residues of texts in either format, each guessed by its own text."""
    kind = guess_format(F.col("text"))
    return residues_pdb(structures.where(kind == "pdb")).unionByName(residues_mmcif(structures.where(kind == "mmcif")))


def chosen_chain(rows: DataFrame, least: int = 4) -> DataFrame:
    """The residues of the first longest chain of ``least`` residues or more of each structure."""
    sizes = rows.groupBy("structure_id", "chain").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = sizes.groupBy("structure_id").agg(F.min_by("chain", F.struct(-F.col("n"), F.col("chain"))).alias("chain"))
    return rows.join(best, ["structure_id", "chain"], "left_semi")


def ideal_helix(lengths: DataFrame, key: str) -> DataFrame:
    """(key, i, x, y, z) of a helix of n residues for each row of (key, n): 100 degrees, 1.5 up and radius 2.3 a residue."""
    rows = lengths.where("n > 0").select(key, F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    angle = F.radians(F.col("i") * 100.0)
    return rows.select(key, "i", (2.3 * F.cos(angle)).alias("x"), (2.3 * F.sin(angle)).alias("y"), (1.5 * F.col("i")).alias("z"))
