"""Views that give the driver tables the shape of the domain. All of them are derived by Spark from whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.functions.parts import parts_by_size
from shiftframe.functions.ranges import numbered

ENGINE_ORDER = (("cdk", 1), ("cascade", 2), ("orca", 3))


def made_once(method):
    """Keep the DataFrame a view method returns on its instance."""

    @functools.wraps(method)
    def get(self):
        made = self.__dict__.setdefault("_made", {})
        if method.__name__ not in made:
            made[method.__name__] = method(self)
        return made[method.__name__]

    return get


class Views:
    """Lazily built views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def _each_engine() -> Column:
        """Every fourth molecule asks for the engines the other way round."""
        turned = F.col("mol_id") % 4 == 1
        return F.explode(
            F.array(
                *[F.struct(F.lit(e).alias("engine"), F.when(turned, 4 - p).otherwise(p).alias("engine_pos")) for e, p in ENGINE_ORDER]
            )
        ).alias("_e")

    @staticmethod
    def _status(mol: Column, engine: Column) -> Column:
        return (
            F.when((engine == "cdk") & (mol % 13 == 0), "error")
            .when((engine == "cascade") & (mol % 11 == 0), "error")
            .when((engine == "orca") & (mol % 7 == 0), "pending")
            .otherwise("ok")
        )

    def engine_results(self) -> DataFrame:
        mols = self.table("lineitem").select(F.col("l_orderkey").alias("mol_id")).distinct()
        rows = mols.select("mol_id", self._each_engine()).select("mol_id", "_e.engine", "_e.engine_pos")
        return rows.withColumn("status", self._status(F.col("mol_id"), F.col("engine")))

    def predictions(self) -> DataFrame:
        """Rows are dealt by atom to as many tasks as their number asks for, and merging by atom goes on in the same tasks."""
        lines = self.table("lineitem")
        per_atom = (
            lines.select(
                F.col("l_orderkey").alias("mol_id"),
                (F.col("l_linenumber") - 1).alias("atom_index"),
                "l_extendedprice",
                "l_discount",
                "l_tax",
            )
            .repartition(parts_by_size(lines), "mol_id", "atom_index")
            .groupBy("mol_id", "atom_index")
            .agg(
                (F.min("l_extendedprice") % F.lit(220.0)).alias("base"),
                F.min("l_discount").alias("disc"),
                F.min("l_tax").alias("tax"),
            )
        )
        rows = per_atom.select("*", self._each_engine()).select(
            "mol_id", "atom_index", "_e.engine", "_e.engine_pos", "base", "disc", "tax"
        )
        offset = (
            F.when(F.col("engine") == "cdk", F.lit(0.0))
            .when(F.col("engine") == "cascade", F.col("disc") * 20 - 1)
            .otherwise(F.col("tax") * 25 - 1)
        )
        return rows.where(~((F.col("engine") == "orca") & (F.col("atom_index") % 3 == 2))).select(
            "mol_id",
            "atom_index",
            "engine",
            "engine_pos",
            self._status(F.col("mol_id"), F.col("engine")).alias("status"),
            (F.col("base") + offset).alias("shift_ppm"),
        )

    @made_once
    def atoms(self) -> DataFrame:
        li = self.table("lineitem").select(
            F.col("l_orderkey").alias("mol_id"),
            "l_extendedprice",
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "l_linenumber",
            "l_discount",
            "l_returnflag",
            "l_linestatus",
        )
        order = [F.col(c) for c in ("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")]
        dense = numbered(li, ["mol_id"], order, "atom_index", start=0)
        k = F.col("l_partkey") % 5
        sk = F.col("l_suppkey")
        return dense.select(
            "mol_id",
            F.col("atom_index").cast("int").alias("atom_index"),
            F.when(k == 0, 6).when(k == 1, 6).when(k == 2, 8).otherwise(1).alias("atomic_num"),
            F.when(k == 0, "C").when(k == 1, "C").when(k == 2, "O").otherwise("H").alias("symbol"),
            (F.col("l_returnflag") == "A").alias("is_aromatic"),
            (F.col("l_linestatus") == "O").alias("is_sp3"),
            F.when(sk % 11 == 0, 1).when(sk % 13 == 0, -1).otherwise(0).alias("formal_charge"),
            F.when(sk % 17 == 0, 1).otherwise(0).alias("radicals"),
            (F.col("l_extendedprice") % F.lit(6.0)).alias("x"),
            (F.col("l_quantity") % F.lit(5.0)).alias("y"),
            (F.col("l_discount") * 30).alias("z"),
        )

    def bonds(self, atoms: DataFrame | None = None) -> DataFrame:
        atoms = self.atoms() if atoms is None else atoms
        return atoms.where("atom_index > 0").select(
            "mol_id",
            F.col("atom_index").alias("bond_idx"),
            F.floor((F.col("atom_index") - 1) / 2.0).cast("int").alias("a"),
            F.col("atom_index").alias("b"),
            F.when(F.col("is_aromatic"), "AROMATIC")
            .when(F.col("is_sp3"), "SINGLE")
            .otherwise("DOUBLE")
            .alias("bond_type"),
            (~F.col("is_sp3")).alias("is_conjugated"),
            F.col("is_aromatic").alias("in_ring"),
        )

    @made_once
    def protons(self) -> DataFrame:
        li = self.table("lineitem").select(
            F.col("l_orderkey").alias("mol_id"),
            F.col("l_extendedprice").alias("ep"),
            F.col("l_partkey").alias("lk"),
            F.col("l_suppkey").alias("sk"),
            F.col("l_quantity").alias("q"),
            F.col("l_linenumber").alias("ln"),
        )
        order = [F.col(c) for c in ("ep", "lk", "sk", "q", "ln")]
        dense = numbered(li, ["mol_id"], order, "atom_index", start=0)
        kind = (F.col("lk") + F.col("sk")) % 4
        return dense.select(
            "mol_id",
            F.col("atom_index").cast("int").alias("atom_index"),
            F.concat(F.lit("h@"), (F.col("ln") % 2).cast("string")).alias("assignment_group"),
            ((F.col("ep") % F.lit(9.0)) / 4).alias("shift_ppm"),
            F.when(kind == 0, "s").when(kind == 1, "d").when(kind == 2, "t").otherwise("m").alias("multiplicity"),
            F.when(kind.isin(1, 2), F.lit(7.0)).alias("coupling_hz"),
        )

    def conformers(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("mol_id"),
            F.col("event_id").alias("conf_id"),
            (F.col("value") / 50).alias("energy_kcal"),
            F.when(F.col("event_id") % 9 == 0, -1).otherwise(0).alias("flag"),
        )

    def conformer_shifts(self) -> DataFrame:
        return (
            self.conformers()
            .select("mol_id", "conf_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("atom_index"))
            .withColumn("shift_ppm", ((F.col("conf_id") * 7 + F.col("atom_index") * 31) % 220).cast("double"))
        )

    def reference_sigma(self) -> DataFrame:
        return self.spark.sql(
            "SELECT functional, basis, nucleus, CAST(sigma AS double) AS sigma FROM VALUES "
            "('pbe', 'def2-svp', '1H', 31.8), ('pbe', 'def2-svp', '13C', 188.1), ('b3lyp', 'def2-tzvp', '1H', 31.6) "
            "AS r(functional, basis, nucleus, sigma)"
        )

    def shieldings(self) -> DataFrame:
        kind = F.col("mol_id") % 3
        return self.atoms().select(
            "mol_id",
            "atom_index",
            "atomic_num",
            F.when(kind == 0, " PBE ").when(kind == 1, "pbe").otherwise("B3LYP").alias("functional"),
            F.when(kind == 2, "def2-TZVP").otherwise("def2-SVP").alias("basis"),
            F.when((F.col("mol_id") + F.col("atom_index")) % 29 == 0, F.lit(None).cast("double"))
            .otherwise(F.col("x") * 20 + F.col("y"))
            .alias("sigma"),
        )

    def log_lines(self) -> DataFrame:
        mol, atom, k = F.col("mol_id"), F.col("atom_index"), F.col("k")
        header = F.concat(F.lit(" Nucleus  "), atom.cast("string"), F.lit(" "), F.col("symbol"), F.lit(" :"))
        value = F.concat(
            F.lit("   Isotropic shielding:    "),
            ((mol * 7 + atom * 13) % 300).cast("string"),
            F.lit("."),
            ((mol * 3 + atom * 17) % 9000 + 1000).cast("string"),
            F.lit(" ppm"),
        )
        return (
            self.atoms()
            .select(
                "mol_id", "atom_index", "symbol", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
            )
            .where((mol % 5 != 0) | (k != 1))
            .select(
                mol.alias("file_id"),
                (atom * 3 + k).alias("line_no"),
                F.when(k == 0, header)
                .when(k == 1, value)
                .otherwise(F.lit("   Shielding anisotropy:     12.3421 ppm"))
                .alias("line"),
            )
        )

    def observed_peaks(self) -> DataFrame:
        return self.table("events").select(
            (F.col("user_id") * 20 + F.col("event_id") % 20).alias("mol_id"),
            F.col("event_id").alias("peak_id"),
            (F.col("value") % F.lit(9.0)).alias("ppm"),
        )

    @made_once
    def signals_1h(self) -> DataFrame:
        li = self.table("lineitem").select(
            F.col("l_orderkey").alias("mol_id"),
            (F.col("l_extendedprice") % F.lit(9.0)).alias("center"),
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "l_linenumber",
        )
        order = [-F.col("center")] + [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_linenumber")]
        dense = numbered(li, ["mol_id"], order, "pos")
        return dense.select(
            "mol_id",
            F.col("pos").cast("int").alias("pos"),
            "center",
            (1 + F.col("l_linenumber") % 3).cast("int").alias("integration"),
            ((F.col("mol_id") % 4) * 0.0175 / 2).alias("half_width"),
        )

    def raw_strings(self) -> DataFrame:
        kind = F.col("p_size") % 6
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.when(kind == 0, "")
            .when(kind == 1, "   ")
            .when(kind == 2, "C(C(=O)O")
            .when(kind == 3, "CC)O(")
            .when(kind == 4, " c1ccccc1[NH2]FP ")
            .otherwise(F.col("p_name"))
            .alias("s"),
        )
