"""Registered queries: files, logs, user functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.parts import parts_of
from shiftframe.functions.workspace import new_path
from shiftframe.operators.engine_apply import apply_engine as apply_predictor
from shiftframe.operators.spectra import spectrum_meta
from shiftframe.plans.queries_signals import _DOMAIN_SQL, _SPECTRUM_SQL, SPEC_NUCLEUS, spectrum_domains, synthesized
from shiftframe.plans.registry import query
from shiftframe.plans.views import Views
from shiftframe.sources import coordinates, logs, manifest, reference, results, spectra
from shiftframe.streaming.debounce import debounce_slots_stream, run_to_table
from shiftframe.streaming.debounce import debounce_stream as debounced


RESPONSES_PER_FILE = 500_000
TEXTS_PER_TASK = 10_000

# --- nested results ---------------------------------------------------------------------------------------------


@query(
    "read_results",
    """
    WITH d AS (SELECT l_orderkey AS mol_id, l_linenumber AS ln, l_partkey AS pk, l_extendedprice AS v FROM lineitem),
    e AS (SELECT d.*, e.engine, CASE WHEN e.engine = 'cdk' AND mol_id % 13 = 0 THEN 'error' WHEN e.engine = 'cascade' AND mol_id % 11 = 0 THEN 'error'
                 WHEN e.engine = 'orca' AND mol_id % 7 = 0 THEN 'pending' ELSE 'ok' END AS status
          FROM d CROSS JOIN (VALUES ('cdk'), ('cascade'), ('orca')) AS e(engine))
    SELECT mol_id, pk AS part, engine, status, CASE WHEN status <> 'ok' THEN 'no ' || engine END AS message,
           CASE WHEN status = 'ok' THEN CAST(k.k AS INTEGER) END AS atom_index, CASE WHEN status = 'ok' THEN 'C' END AS symbol,
           CASE WHEN status = 'ok' THEN round(v + k.k, 6) END AS shift_ppm
    FROM e JOIN (VALUES (0), (1)) AS k(k) ON k.k = 0 OR (status = 'ok' AND ln % 2 = 0)
    """,
)
def read_results(v: Views) -> DataFrame:
    """Responses are written as JSON documents, one per row of the table, and read back with the fixed schema."""
    mol = F.col("l_orderkey")

    def result(engine: str):
        status = v._status(mol, F.lit(engine))
        shift = [
            F.struct(F.lit(k).alias("atom_index"), F.lit("C").alias("symbol"), (F.col("l_extendedprice") + k).alias("shift_ppm"))
            for k in (0, 1)
        ]
        some = F.when(F.col("l_linenumber") % 2 == 0, F.array(*shift)).otherwise(F.array(shift[0]))
        return F.struct(
            F.lit(engine).alias("engine"),
            status.alias("status"),
            F.when(status != "ok", f"no {engine}").alias("message"),
            F.when(status == "ok", some).otherwise(F.slice(some, 1, 0)).alias("shifts"),
        )

    engines = F.create_map(*[part for e in ("cdk", "cascade", "orca") for part in (F.lit(e), result(e))])
    path = new_path(v.spark, "responses")
    tasks = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt before the documents are made, as those are many times longer than the rows
    dealt = v.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").repartition(tasks, "l_orderkey", "l_partkey")
    documents = dealt.select(mol.alias("mol_id"), F.col("l_partkey").cast("string").alias("canonical_smiles"), engines.alias("engines"))
    # a compressed file is read by one task, so files are cut
    documents.write.option("compression", "gzip").option("maxRecordsPerFile", RESPONSES_PER_FILE).json(path)
    rows = results.engine_shifts(results.read_responses(v.spark, path), "mol_id", "canonical_smiles")
    return rows.select(
        "mol_id",
        F.col("canonical_smiles").cast("long").alias("part"),
        "engine",
        "status",
        "message",
        "atom_index",
        "symbol",
        F.round("shift_ppm", 6).alias("shift_ppm"),
    )


# --- reference tables -------------------------------------------------------------------------------------------


@query(
    "reference_load",
    """
    SELECT lower(p_brand) AS functional, lower(p_type) || '-' || p_partkey AS basis, n.nucleus,
           round(p_retailprice / CASE n.nucleus WHEN '1H' THEN 10 ELSE 2 END, 6) AS sigma
    FROM part CROSS JOIN (VALUES ('1H'), ('13C')) AS n(nucleus) WHERE p_partkey % 10 <> 3
    """,
)
def reference_load(v: Views) -> DataFrame:
    """One document per part; every tenth is cut short and counts as empty."""
    key = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" |"), F.col("p_type"), F.lit("-"), F.col("p_partkey").cast("string"))
    values = F.struct((F.col("p_retailprice") / 10).alias("1H"), (F.col("p_retailprice") / 2).alias("13C"))
    text = F.to_json(F.create_map(key, values))
    cut = F.when(F.col("p_partkey") % 10 == 3, F.substring(text, 1, 20)).otherwise(text)
    path = new_path(v.spark, "reference-documents")
    v.table("part").select(cut.alias("value")).write.text(path)
    return reference.load_reference(v.spark, path, whole_files=False).withColumn("sigma", F.round("sigma", 6))


@query(
    "reference_upsert",
    """
    SELECT lower(p_brand) || '-' || p_partkey AS functional, lower(p_type) AS basis, '1H' AS nucleus,
           CASE WHEN p_partkey % 3 = 0 THEN p_retailprice WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 ELSE p_retailprice + 2 END AS sigma
    FROM part
    """,
)
def reference_upsert(v: Views) -> DataFrame:
    """Three additions with overlapping methods; what is in the table first stays."""
    path = new_path(v.spark, "reference-table")
    part = v.table("part").select(
        "p_partkey",
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("functional"),
        F.concat(F.col("p_type"), F.lit(" ")).alias("basis"),
        F.lit("1H").alias("nucleus"),
        F.col("p_retailprice").alias("sigma"),
    )
    later = part.withColumn("sigma", F.col("sigma") + 1)
    last = part.withColumn("sigma", F.col("sigma") + 2)
    reference.upsert_reference(v.spark, path, part.where("p_partkey % 3 = 0"))
    reference.upsert_reference(v.spark, path, later.where("p_partkey % 2 = 0"))
    return reference.upsert_reference(v.spark, path, last)


# --- logs -------------------------------------------------------------------------------------------------------


@query(
    "log_scan",
    """
    SELECT CAST(l_suppkey % 16 AS INTEGER) AS run, count(*) AS n_lines, bool_or(l_suppkey % 16 % 2 = 0 AND l_partkey % 50 = 0) AS finished
    FROM lineitem GROUP BY l_suppkey % 16
    """,
)
def log_scan(v: Views) -> DataFrame:
    """A corpus of text files, one folder per run, scanned line by line."""
    run = F.col("l_suppkey") % 16
    step = F.concat(F.lit("cycle "), F.col("l_partkey").cast("string"), F.lit("  energy "), F.col("l_extendedprice").cast("string"))
    line = F.when((run % 2 == 0) & (F.col("l_partkey") % 50 == 0), "      ****ORCA TERMINATED NORMALLY****").otherwise(step)
    path = new_path(v.spark, "logs")
    v.table("lineitem").select(run.alias("run"), line.alias("value")).write.partitionBy("run").text(path)
    lines = logs.read_lines(v.spark, path).withColumn("run", F.regexp_extract("file_id", r"/run=(\d+)/", 1).cast("int"))
    return logs.log_status(lines, keys=["run"])


@query(
    "log_sections",
    r"""
    SELECT file_id, CAST(regexp_extract(line, 'Nucleus\s+(\d+)', 1) AS INTEGER) AS atom_index,
           CAST(regexp_extract(nxt, '(-?\d+\.\d+)', 1) AS DOUBLE) AS sigma
    FROM (SELECT *, lead(line) OVER (PARTITION BY file_id ORDER BY line_no) AS nxt FROM log_lines) l
    WHERE line LIKE ' Nucleus%' AND nxt LIKE '%Isotropic%'
    """,
)
def log_sections(v: Views) -> DataFrame:
    """Logs of many molecules each, written as text files and read line by line.

    The atoms of the molecules in one log are told apart by their numbers, 64 to a molecule.
    """
    run, atom = F.col("file_id") % 16, F.col("atom_index")
    numbered = F.concat(F.lit(" Nucleus  "), (F.floor(F.col("file_id") / 16) * 64 + F.regexp_extract("line", r"(\d+)", 1).cast("long")).cast("string"), F.lit(" X :"))
    lines = v.log_lines().withColumn("value", F.when(F.startswith("line", F.lit(" Nucleus")), numbered).otherwise(F.col("line")))
    path = new_path(v.spark, "logs")
    dealt = lines.withColumn("run", run).repartition("run").sortWithinPartitions("run", "file_id", "line_no")
    dealt.select("run", "value").write.partitionBy("run").text(path)
    of = F.regexp_extract("file_id", r"/run=(\d+)/", 1).cast("long")
    return logs.read_log_sections(v.spark, path).select(
        (F.floor(atom / 64) * 16 + of).cast("long").alias("file_id"), (atom % 64).alias("atom_index"), "sigma"
    )


# --- coordinate files and decks ---------------------------------------------------------------------------------


@query(
    "xyz_scan",
    """
    SELECT l_orderkey AS file_id, l_partkey AS part, CASE l_partkey % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'no coordinates' WHEN 2 THEN 'bad number' ELSE 'ok' END AS status,
           CASE WHEN l_partkey % 7 > 2 THEN CAST(k.k AS INTEGER) END AS atom_index, CASE WHEN l_partkey % 7 > 2 THEN CASE k.k WHEN 0 THEN 'C' ELSE 'H' END END AS symbol,
           CASE WHEN l_partkey % 7 > 2 THEN round(l_extendedprice + k.k, 6) END AS x, CASE WHEN l_partkey % 7 > 2 THEN l_quantity END AS y, CASE WHEN l_partkey % 7 > 2 THEN CAST(l_linenumber AS DOUBLE) END AS z
    FROM lineitem JOIN (VALUES (0), (1), (2)) AS k(k) ON k.k = 0 OR (l_partkey % 7 > 2 AND k.k <= l_linenumber % 3)
    """,
)
def xyz_scan(v: Views) -> DataFrame:
    """One frame per row of the table, many to a file, written and read again; some are cut short, empty or broken."""
    kind = F.col("l_partkey") % 7

    def line(symbol: str, k: int, x=None):
        x = (F.col("l_extendedprice") + k).cast("string") if x is None else x
        return F.concat_ws("   ", F.lit(symbol), x, F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string"))

    rows = F.slice(F.array(line("C", 0), line("H", 1), line("H", 2)), F.lit(1), F.col("l_linenumber") % 3 + 1)
    good = F.array_join(rows, "\n")
    body = F.when(kind == 1, "C 1.0 2.0\nH").when(kind == 2, F.concat_ws("\n", good, line("H", 0, F.lit("1.0.0")))).otherwise(good)
    title = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" part "), F.col("l_partkey").cast("string"))
    text = F.when(kind == 0, F.concat_ws("\n", F.lit(" 2"), title)).otherwise(F.concat_ws("\n", F.lit(" 2"), title, body, F.lit("")))
    path = new_path(v.spark, "coordinates")
    tasks = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    v.table("lineitem").repartition(tasks, "l_orderkey", "l_partkey").select(text.alias("value")).write.text(path)
    number = lambda name: F.regexp_extract("content", rf"{name} (\d+)", 1).cast("long")
    frames = coordinates.read_frames(v.spark, path).select(number("order").alias("file_id"), number("part").alias("part"), "content")
    return coordinates.parse_coordinates(frames).withColumn("x", F.round("x", 6))


_DECK_HEAD = "'! PBE def2-SVP NMR TightSCF', '', '%maxcore 2000', '%pal', '  nprocs 4', 'end', ''"


@query(
    "render_decks",
    f"""
    WITH g AS (SELECT mol_id, sum(formal_charge) AS c, sum(radicals) + 1 AS s,
                      string_agg(printf('  %-2s  %14.8f  %14.8f  %14.8f', symbol, x, y, z), chr(10) ORDER BY atom_index) AS block FROM atoms GROUP BY mol_id)
    SELECT mol_id, array_to_string([{_DECK_HEAD}, '* xyz ' || c || ' ' || s, block, '*', ''], chr(10)) AS deck FROM g
    """,
)
def render_decks(v: Views) -> DataFrame:
    return coordinates.render_decks(v.atoms(), functional="PBE", basis="def2-SVP", cpus=4, ram_mb=2000)


@query(
    "manifest_check",
    """
    SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 7 = 0 THEN 'unlisted' WHEN doc_id % 10 = 0 THEN 'mismatch' ELSE 'ok' END AS status,
           doc_id % 7 = 0 OR doc_id % 10 <> 0 AS accepted FROM documents
    """,
)
def manifest_check(v: Views) -> DataFrame:
    """Whole document texts against a manifest that is wrong for every tenth and silent on every seventh."""
    documents = v.table("documents").select("doc_id", "text")
    listed = documents.where("doc_id % 7 <> 0").select(
        "doc_id",
        F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")), 256).alias("sha256"),
    )
    return manifest.manifest_check(documents, listed, key="doc_id", content="text")


@query(
    "manifest_files",
    """
    SELECT bundle, length, sha256(content) AS sha256, CASE WHEN bundle % 7 = 0 THEN 'unlisted' WHEN bundle % 10 = 0 THEN 'mismatch' ELSE 'ok' END AS status,
           bundle % 7 = 0 OR bundle % 10 <> 0 AS accepted
    FROM (SELECT doc_id // 16 AS bundle, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS content,
                 CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS length FROM documents GROUP BY ALL) b
    """,
)
def manifest_files(v: Views) -> DataFrame:
    """Sixteen document texts to a file, written and digested in chunks, against a manifest that is wrong for every tenth
    file and silent on every seventh. The manifest comes from the texts, not from the files."""
    bundle = F.floor(F.col("doc_id") / 16).alias("bundle")
    documents = v.table("documents")
    texts = documents.select(bundle, "doc_id", "text").where("bundle is not null")
    path = new_path(v.spark, "bundles")
    parts = parts_of(v.spark, documents.count(), TEXTS_PER_TASK)
    manifest.write_groups(texts, path, key="bundle", order=["doc_id"], line="text", parts=parts)
    line = F.struct("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("line"))
    whole = texts.where("bundle % 7 <> 0").groupBy("bundle").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    wrong = F.when(F.col("bundle") % 10 == 0, "?").otherwise("")
    listed = whole.select("bundle", F.sha2(F.concat(F.array_join("lines.line", ""), wrong), 256).alias("sha256"))
    files = manifest.digest_files(v.spark, path).withColumn("bundle", F.regexp_extract("path", r"/(-?\d+)\.txt$", 1).cast("long"))
    return manifest.manifest_check(files, listed, key="bundle", content=None, keep=["length"])


@query(
    "write_spectra",
    f"""
    SELECT s.spec_id, s.i, round(s.x, 6) AS x, round(s.y, 6) AS y, '{SPEC_NUCLEUS}' AS nucleus, 'carbon' AS experiment,
           round((d.low + d.high) * 50, 6) AS frequency_offset, round(d.high - d.low, 6) AS spectral_width
    FROM ({_SPECTRUM_SQL}) s JOIN ({_DOMAIN_SQL}) d ON d.spec_id = s.spec_id
    """,
)
def write_spectra(v: Views) -> DataFrame:
    """Points and metadata records written by nucleus and read back."""
    path = new_path(v.spark, "spectra")
    points = synthesized(v).withColumn("nucleus", F.lit(SPEC_NUCLEUS))
    spectra.write_spectra(points, spectrum_meta(spectrum_domains(v), nucleus=SPEC_NUCLEUS), path)
    read, meta = spectra.read_spectra(v.spark, path)
    told = meta.select("spec_id", "nucleus", "experiment", F.round("frequency_offset", 6).alias("frequency_offset"), F.round("spectral_width", 6).alias("spectral_width"))
    return read.join(told, ["spec_id", "nucleus"]).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


# --- user functions and streams ---------------------------------------------------------------------------------


@query(
    "apply_engine",
    """
    WITH m AS (SELECT id AS mol_id, trim(s) AS t FROM raw_strings),
    f AS (SELECT *, t = '' OR t LIKE '%FP' AS bad FROM m),
    c AS (SELECT mol_id, t, k.i AS i, substr(t, CAST(k.i + 1 AS INTEGER), 1) AS ch FROM f CROSS JOIN range(80) AS k(i) WHERE NOT bad AND k.i < length(t)),
    h AS (SELECT * FROM c WHERE regexp_full_match(ch, '[a-zA-Z]'))
    SELECT f.mol_id, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status,
           CASE WHEN bad THEN 'letters prediction failed. Reference ID: ' || substr(sha256(CAST(f.mol_id AS VARCHAR) || '|letters'), 1, 12) END AS message,
           CAST(h.i AS INTEGER) AS atom_index, upper(h.ch) AS symbol, unicode(h.ch) * CAST(0.5 AS DOUBLE) AS shift_ppm
    FROM f LEFT JOIN h ON h.mol_id = f.mol_id
    """,
)
def apply_engine(v: Views) -> DataFrame:
    """A predictor that values letters; it fails on empty text and names a wrong atom for some."""

    def letters(molecule, nucleus, scale):
        text = molecule["s"].strip()
        if not text:
            raise ValueError("nothing to predict")
        for i, char in enumerate(text):
            if char.isalpha():
                yield {"atom_index": i, "symbol": char.upper(), "shift_ppm": ord(char) * scale}
        if text.endswith("FP"):
            yield {"atom_index": 999, "symbol": "F", "shift_ppm": 0.0}

    molecules = v.raw_strings().select(
        F.col("id").alias("mol_id"), "s", F.lit("1H").alias("nucleus"), F.length(F.trim("s")).alias("n_atoms")
    )
    rows = apply_predictor(molecules, letters, engine="letters", options={"scale": 0.5})
    return rows.select("mol_id", "status", "message", "atom_index", "symbol", "shift_ppm")


@query(
    "debounce_stream",
    """
    SELECT event_id, user_id, event_type, round(value, 6) AS value
    FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, max(ts) OVER () AS newest FROM events) e
    WHERE (nxt IS NULL OR nxt - ts >= INTERVAL 1 HOUR) AND ts + INTERVAL 1 HOUR <= newest - INTERVAL 2 HOUR
    """,
)
def debounce_stream(v: Views) -> DataFrame:
    """Sessions still open under the watermark at the end of the stream are not emitted."""
    source = v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet")
    stream = source.parquet(v.folder).drop("props")
    kept = run_to_table(debounced(stream, delay_ms=3_600_000, watermark="2 hours"), "debounced")
    return kept.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@query(
    "debounce_slots_stream",
    """
    SELECT event_id, user_id, event_type, round(value, 6) AS value
    FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, max(ts) OVER () AS newest FROM events) e
    WHERE (nxt IS NULL OR nxt - ts >= INTERVAL 1 HOUR) AND date_trunc('hour', ts) + INTERVAL 2 HOUR <= newest - INTERVAL 2 HOUR
    """,
)
def debounced_slots(v: Views) -> DataFrame:
    """Like ``debounce_stream``, with the state of a key spread by time slot."""
    source = v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet")
    stream = source.parquet(v.folder).drop("props")
    kept = run_to_table(debounce_slots_stream(stream, delay_ms=3_600_000, watermark="2 hours"), "debounced")
    return kept.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))
