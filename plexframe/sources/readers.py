"""Readers: lines are split and cast by column expressions, so parsing runs where the file is read.

Malformed rows raise when they are read (ANSI casts and assertions), unless
a reader says that it skips them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REGION = r"^([^:\t]+)[:\t]([0-9,]+)[-\t]([0-9,]+)$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("length(trim(value)) > 0")


def _fields(path_lines: DataFrame) -> DataFrame:
    return path_lines.select(F.split("value", "\t").alias("f"))


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("long"))


def bed(spark: SparkSession, path: str, extra: bool = False) -> DataFrame:
    """contig, start, stop (and ``extra``, the further columns) of a BED file; browser, track and comment lines are skipped.

    Fewer than three columns, bad numbers, negative starts and start >= stop raise.
    """
    f = _fields(_lines(spark, path).where(~F.col("value").rlike("^(browser|track|#)")))
    start, stop = F.try_element_at("f", F.lit(2)).try_cast("long"), F.try_element_at("f", F.lit(3)).try_cast("long")
    ok = (F.size("f") >= 3) & (start >= 0) & (start < stop)
    columns = [F.col("f")[0].alias("contig"), _checked(F.coalesce(ok, F.lit(False)), start, "bad interval").alias("start"), stop.alias("stop")]
    if extra:
        columns.append(F.slice("f", F.lit(4), F.greatest(F.size("f") - 3, F.lit(0))).alias("extra"))
    return f.select(*columns)


def region(text: Column) -> Column:
    """contig, start (0-based) and stop of contig:start-end or a tab-separated region; null if it is neither."""
    number = lambda k: F.regexp_replace(F.regexp_extract(text, REGION, k), ",", "").cast("long")
    offset = F.when(text.contains("\t"), 0).otherwise(1)
    return F.when(text.rlike(REGION), F.struct(F.regexp_extract(text, REGION, 1).alias("contig"), (number(2) - offset).alias("start"), number(3).alias("stop")))


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """contig, length, rank of a FASTA index, in the order of its lines."""
    numbered = number_lines(spark.read.text(path)).where("length(value) > 0")
    f = F.split("value", "\t")
    return numbered.select(f[0].alias("contig"), f[1].cast("long").alias("length"), F.col("line").alias("rank"))


def whole_contigs(lengths: DataFrame) -> DataFrame:
    """One region per contig."""
    return lengths.select("contig", F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((file, block), from, to) of a batch's stretches of one split's lines."""
    file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)], strict=True):
        if hi > lo:
            yield (file.dictionary[int(code[lo])].as_py(), int(block[lo])), lo, hi


def _at(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Appends ``file`` and ``line`` (from 0 within its file) to rows of ``spark.read.text``.

    Lines are counted per split first; the sums of a file's earlier splits,
    one row per split, then shift the counts inside each split.
    """
    at = _at(lines)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            k = np.empty(b.num_rows, np.int64)
            for key, lo, hi in _runs(b):
                k[lo:hi] = np.arange(seen.get(key, 0), seen.get(key, 0) + hi - lo)
                seen[key] = int(k[hi - 1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k)], names=[*b.schema.names, "k"])

    from pyspark.sql import Window

    inside = at.mapInArrow(number, "value string, file string, block long, k long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = at.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # A row per split of a file, so lines stay where they are read.
    return inside.join(F.broadcast(splits), ["file", "block"]).select("value", "file", (F.col("k") + F.col("shift")).alias("line"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual of FASTQ files, plain or compressed; a record must have four lines and equal lengths.

    Records are put together where they are read; only lines of those that a
    split cuts are grouped.
    """
    lines = number_lines(spark.read.text(path))
    parts = ("name", "seq", "plus", "qual")

    def whole(cut: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = []  # lines of a record that isn't whole yet: (file, line, value)
            for b in batches:
                value, line = b.column("value"), b.column("line").to_numpy()
                file = b.column("file").to_pylist()
                out: list = []
                for k in range(b.num_rows):
                    if held and (file[k] != held[-1][0] or line[k] != held[-1][1] + 1):
                        out.append((held[0], held))
                        held = []
                    held.append((file[k], int(line[k]), value[k].as_py()))
                    if line[k] % 4 == 3:
                        out.append((held[0], held))
                        held = []
                yield batch(out)
            yield batch([(held[0], held)] if held else [])

        def batch(records: list) -> pa.RecordBatch:
            rows = []
            for (file, line, _), own in records:
                if (len(own) < 4) == cut:
                    of = {k % 4: v for _, k, v in own}
                    rows.append((file, line // 4, *(of.get(k) for k in range(4))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(columns)], names=["file", "record", *parts])

        return lines.mapInArrow(run, "file string, record long, name string, seq string, plus string, qual string")

    pieces = whole(True).groupBy("file", "record").agg(*[F.max(n).alias(n) for n in parts])
    record = whole(False).unionByName(pieces)
    ok = F.col("name").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    name = F.when(F.coalesce(ok, F.lit(False)), F.substring("name", 2, 1 << 30)).otherwise(F.raise_error(F.lit("bad FASTQ record")))
    return record.select(name.alias("name"), "seq", "qual")


def fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """contig, start, seq of the sequence lines of a FASTA file: pieces that cover each contig in order.

    Every split is read by itself; the contig that goes on from the splits
    before, and how long it is by then, comes from one row per split.
    """
    from pyspark.sql import Window

    at = _at(spark.read.text(path))

    def run(summary: bool):
        import re

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict = {}  # the split's contig so far (None: not its own) and its length
            for b in batches:
                values, rows = b.column("value").to_pylist(), []
                for key, lo, hi in _runs(b):
                    name, length = state.get(key, (None, 0))
                    for text in values[lo:hi]:
                        if text.startswith(">"):
                            found = re.match(r"^>(\S+)", text)
                            name, length = found[1] if found else "", 0
                        elif text:
                            if not summary:
                                rows.append((*key, name, length, text))
                            length += len(text)
                    state[key] = name, length
                if not summary:
                    yield batch(rows, 5)
            if summary:
                yield batch([(*key, *v) for key, v in state.items()], 4)

        def batch(rows: list, n: int) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()][:n]
            columns = list(zip(*rows, strict=True)) or [()] * n
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "block", "own", "at", "value"][:n])

        return at.mapInArrow(go, "file string, block long, own string, at long" + ("" if summary else ", value string"))

    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    splits = run(True).withColumn("group", F.sum(F.col("own").isNotNull().cast("int")).over(w))
    so_far = F.sum("at").over(Window.partitionBy("file", "group").orderBy("block"))
    ends = splits.withColumn("length", so_far).select("file", "block", F.lag("length").over(w).alias("shift"), F.last("own", ignorenulls=True).over(before).alias("carried"))
    pieces = run(False).join(F.broadcast(ends), ["file", "block"])  # a row per split
    start = F.col("at") + F.when(F.col("own").isNull(), F.coalesce("shift", F.lit(0))).otherwise(0)
    return pieces.select(F.coalesce("own", "carried").alias("contig"), start.alias("start"), (F.upper("value") if upper else F.col("value")).alias("seq"))


def slice_sequence(pieces: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (contig, start, stop) with ``seq`` from FASTA pieces; a region beyond the sequence raises."""
    from plexframe.operators.intervals import range_join

    p = pieces.withColumn("stop", F.col("start") + F.length("seq"))
    j = range_join(regions, p).withColumn("part", F.expr("substring(r_seq, cast(greatest(start, r_start) - r_start + 1 as int), cast(least(stop, r_stop) - greatest(start, r_start) as int))"))
    out = j.groupBy("contig", "start", "stop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "part"))), lambda x: x["part"]), "").alias("seq"))
    ok = F.length("seq") == F.col("stop") - F.col("start")
    return out.withColumn("seq", F.when(ok, F.col("seq")).otherwise(F.raise_error(F.lit("region outside the sequence"))))


def vcf_header(spark: SparkSession, path: str) -> dict:
    """{'info': {id: (number, type)}, 'format': ..., 'filter': [ids], 'samples': [names], 'contigs': {name: length}} of the ## and #CHROM lines."""
    import re

    out: dict = {"info": {}, "format": {}, "filter": [], "samples": [], "contigs": {}}
    first = next((p for p in parts(spark, path) if not _lines(spark, p).isEmpty()), path)
    n = 1000
    while True:  # a header is at the top of the first file: only as many lines are read as it has
        top = [r["value"] for r in _lines(spark, first).limit(n).collect()]
        if len(top) < n or not top[-1].startswith("#"):
            break
        n *= 4
    for line in (x for x in top if x.startswith("#")):
        if m := re.match(r"##(INFO|FORMAT)=<ID=([^,]+),Number=([^,]+),Type=([^,]+)", line):
            out[m[1].lower()][m[2]] = (m[3], m[4])
        elif m := re.match(r"##FILTER=<ID=([^,]+)", line):
            out["filter"].append(m[1])
        elif m := re.match(r"##contig=<ID=([^,>]+)(?:,length=([0-9]+))?", line):
            out["contigs"][m[1]] = int(m[2]) if m[2] else None
        elif line.startswith("#CHROM"):
            out["samples"] = line.split("\t")[9:]
    return out


def vcf(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """contig, pos (0-based), id, ref, alts, qual, filters, info (map to arrays of texts), samples (name, format map)."""
    f = _fields(_lines(spark, path).where(~F.col("value").startswith("#")))
    missing = lambda c: F.when(c != ".", c)
    pairs = F.transform(F.filter(F.split(F.col("f")[7], ";"), lambda x: (x != ".") & (x != "")), lambda x: F.struct(F.split(x, "=", 2)[0], F.when(x.contains("="), F.split(F.split(x, "=", 2)[1], ",")).otherwise(F.array().cast("array<string>"))))
    keys = F.split(F.try_element_at("f", F.lit(9)), ":")
    names = F.array(*map(F.lit, samples)) if samples else None
    values = F.transform(F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))), lambda v, i: F.struct((F.try_element_at(names, i + 1) if names is not None else i.cast("string")).alias("name"), F.map_from_entries(F.transform(keys, lambda k, j: F.struct(k, F.split(F.coalesce(F.try_element_at(F.split(v, ":"), j + 1), F.lit(".")), ",")))).alias("format")))
    return f.select(
        F.col("f")[0].alias("contig"), (F.col("f")[1].cast("long") - 1).alias("pos"), missing(F.col("f")[2]).alias("id"), F.col("f")[3].alias("ref"),
        F.when(F.col("f")[4] == ".", F.array().cast("array<string>")).otherwise(F.split(F.col("f")[4], ",")).alias("alts"),
        missing(F.col("f")[5]).cast("double").alias("qual"), F.when(F.col("f")[6] == ".", F.array().cast("array<string>")).otherwise(F.split(F.col("f")[6], ";")).alias("filters"),
        F.map_from_entries(pairs).alias("info"), F.when(F.size("f") > 9, values).otherwise(F.array().cast("array<struct<name:string,format:map<string,array<string>>>>")).alias("samples"),
    )


def info_values(info: Column, name: str, kind: str = "double") -> Column:
    """The typed values of an INFO field; an absent field is empty, '.' is null, a flag is true if it is there."""
    if kind == "flag":
        return F.map_contains_key(info, name)
    return F.coalesce(F.transform(F.try_element_at(info, F.lit(name)), lambda x: x.try_cast(kind)), F.array().cast(f"array<{kind}>"))


def parts(spark: SparkSession, path: str) -> list[str]:
    """The files of a table in order of their names, without hidden ones."""
    return [p for p in paths(spark, path) if not p.rsplit("/", 1)[-1].startswith(("_", "."))]


def first_line(spark: SparkSession, path: str, comment: str = "#") -> str | None:
    """The first line of a table that is no comment, of its first file by name; the order of Spark's rows says nothing about that."""
    for p in parts(spark, path):
        if found := _lines(spark, p).where(~F.col("value").startswith(comment)).limit(1).collect():
            return found[0]["value"]
    return None


def table(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A tab-separated table with ``#`` comments; rows that don't fit the schema raise.

    Of several files the first has the header; others may repeat it.
    """
    if not header:
        return spark.read.csv(path, sep="\t", header=False, schema=schema, comment="#", mode="FAILFAST")
    head = first_line(spark, path)
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != F.lit(head)))
    return rows.select(F.from_csv("value", F.lit(schema), {"sep": "\t", "mode": "FAILFAST"}).alias("r")).select("r.*")


COVERAGE = "contig string, start long, stop long, counts double, total_coverage double, on_target boolean, mean_mapq double"
INTERVALS = "contig string, start long, stop long, gc double, mappability double, on_target boolean"
OBSERVATIONS = "contig string, start long, stop long, value double"
DEPTHS = "contig string, start long, stop long, ref_ad int, alt_ad int"
SEGMENTS = "id string, contig string, start long, stop long, num_log_ratio long, num_snp long, mean_log_ratio double, mean_dh double, tcn int, mcn int"


def segments(spark: SparkSession, path: str, schema: str = SEGMENTS) -> DataFrame:
    """A SEG table; its 1-based inclusive starts become 0-based."""
    return table(spark, path, schema).withColumn("start", F.col("start") - 1)


def features(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """The needed columns of a feature table, by its own header; rows with too few columns are skipped, bad numbers raise."""
    lines = spark.read.text(path).where(~F.col("value").startswith("##"))
    head = first_line(spark, path, "##") or ""
    names = head.lstrip("#").split("\t")
    lacking = [c for c in needed if c not in names]
    if lacking:
        raise ValueError(f"columns {lacking} are missing")
    f = _fields(lines.where(F.col("value") != head)).where(F.size("f") >= len(names))
    text = {"chrom", "ref", "alt"}
    return f.select(*[(F.col("f")[names.index(c)] if c in text else F.col("f")[names.index(c)].cast("long" if c == "pos" else "double")).alias(c) for c in needed])


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="sample_name string, sample_sid string", mode="FAILFAST")


def block_list(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.trim("value").alias("key")).distinct()


def hotspots(records: DataFrame) -> DataFrame:
    """Keys contig_pos_ref_alt (1-based) of every alternative of VCF records."""
    each = records.select("contig", "pos", "ref", F.explode("alts").alias("alt"))
    return each.select(F.concat_ws("_", "contig", (F.col("pos") + 1).cast("string"), "ref", "alt").alias("key")).distinct()


def document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document: an adapter manifest, a workflow profile or an STR catalogue."""
    return spark.read.json(path, schema=schema, multiLine=True)


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, contig, pos (0-based), mapq, cigar, seq, qual and tags of SAM text."""
    f = _fields(_lines(spark, path).where(~F.col("value").startswith("@")))
    tags = F.map_from_entries(F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.split(t, ":", 3)[0], F.split(t, ":", 3)[2])))
    return f.select(F.col("f")[0].alias("qname"), F.col("f")[1].cast("int").alias("flag"), F.when(F.col("f")[2] != "*", F.col("f")[2]).alias("contig"), (F.col("f")[3].cast("long") - 1).alias("pos"), F.col("f")[4].cast("int").alias("mapq"), F.when(F.col("f")[5] != "*", F.col("f")[5]).alias("cigar"), F.col("f")[9].alias("seq"), F.col("f")[10].alias("qual"), tags.alias("tags"))


def on_contigs(regions: DataFrame, lengths: DataFrame) -> DataFrame:
    """The regions of known contigs, clipped to these; a region that begins beyond its contig's end raises when it is read."""
    out = regions.join(lengths.select("contig", "length"), "contig")
    start = F.when(F.col("start") >= F.col("length"), F.raise_error(F.lit("region outside its contig")).cast("long")).otherwise(F.col("start"))
    return out.withColumns({"start": start, "stop": F.least("stop", "length")}).drop("length")


def collapser_regions(lengths: DataFrame) -> DataFrame:
    """Whole contigs and, with a null contig, the place of unmapped reads."""
    none = lengths.limit(1).select(F.lit(None).cast("string").alias("contig"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))
    whole = whole_contigs(lengths)
    return whole.withColumn("contig", F.col("contig").cast("string")).unionByName(none)


def track_mean(regions: DataFrame, track: DataFrame) -> DataFrame:
    """Appends ``mean``: a track's (contig, start, stop, score) score over a region, by length; null where it has none."""
    from plexframe.operators.intervals import range_join

    at = ["contig", "start", "stop"]
    shared = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    mean = range_join(regions.select(*at).distinct(), track.select(*at, "score")).groupBy(*at).agg((F.sum(shared * F.col("r_score")) / F.sum(shared)).alias("mean"))
    return regions.join(mean, at, "left")


def paths(spark: SparkSession, path: str) -> list[str]:
    """The files below a path of any file system that Spark reads, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    out = []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def expanded(spark: SparkSession, inputs: list[str]) -> list[str]:
    """Files, folders (with all below them) and lists of files (names that end in .list) as files."""
    out = []
    for x in inputs:
        out += [r["value"] for r in spark.read.text(x).collect() if r["value"].strip()] if x.endswith(".list") else paths(spark, x)
    return out


def tag(tags: Column, name: str, kind: str = "string") -> Column:
    """An optional field of an alignment by its type; null without it or of another type."""
    value = F.try_element_at(tags, F.lit(name))
    return value if kind == "string" else value.try_cast(kind)


def in_region(records: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    """The VCF records whose reference allele touches a region."""
    return records.where((F.col("contig") == contig) & (F.col("pos") < stop) & (F.col("pos") + F.length("ref") > start))


def genotype_sets(records: DataFrame) -> DataFrame:
    """gt, keys of biallelic records' first sample: the variants of every genotype; a set is a truth file's."""
    gt = F.array_join(F.col("samples")[0]["format"]["GT"], ",")
    key = F.concat_ws("_", "contig", (F.col("pos") + 1).cast("string"), "ref", F.col("alts")[0])
    return records.select(F.regexp_replace(gt, r"\|", "/").alias("gt"), key.alias("key")).distinct()
