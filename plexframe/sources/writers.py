"""Writers: sorted text parts that read in order, headers first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ordered_lines(lines: DataFrame, header: list[str], order: list[str]) -> DataFrame:
    """``lines`` (value and the order columns) range-partitioned and sorted, header lines before everything."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(k, x) for k, x in enumerate(header)], "hk long, value string").select(F.lit(0).alias("part"), "hk", "value", *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order])
    body = lines.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("hk"), "value", *order)
    keys = ["part", "hk", *order]
    return head.unionByName(body).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value")


def write_text(lines: DataFrame, path: str, compression: str = "none") -> None:
    lines.write.text(path, compression=compression)


def row_text(columns: list[str | Column], missing: str = "NA") -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(missing)) for c in columns])


def tsv(df: DataFrame, path: str, metadata: dict[str, str], order: list[str]) -> None:
    """A table behind ##key=value lines and its header; nulls are NA."""
    header = [f"##{k}={v}" for k, v in metadata.items()] + ["\t".join(df.columns)]
    write_text(ordered_lines(df.withColumn("value", row_text(df.columns)).select("value", *order), header, order), path)


def bed(df: DataFrame, path: str, extra: list[str] | None = None) -> None:
    lines = df.select(row_text(["contig", "start", "stop", *(extra or [])], ".").alias("value"), "contig", "start", "stop")
    write_text(ordered_lines(lines, [], ["contig", "start", "stop"]), path)


def segments(df: DataFrame, path: str, columns: list[str]) -> None:
    """SEG: starts become 1-based."""
    out = df.withColumn("start", F.col("start") + 1)
    lines = out.select(row_text(columns).alias("value"), "contig", "start")
    write_text(ordered_lines(lines, ["\t".join(columns)], ["contig", "start"]), path)


def vcf(records: DataFrame, path: str, header: list[str], contig_order: DataFrame, samples: list[str]) -> None:
    """VCF text of records as ``readers.vcf`` gives them, in the order of (contig, rank) and position."""
    join = lambda c, sep, empty: F.when(F.size(c) > 0, F.array_join(c, sep)).otherwise(empty)
    entries = F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(F.size(e["value"]) > 0, F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))).otherwise(e["key"]))
    keys = F.map_keys(F.col("samples")[0]["format"])
    values = F.transform("samples", lambda s: F.array_join(F.transform(keys, lambda k: F.array_join(s["format"][k], ",")), ":"))
    fields = ["contig", (F.col("pos") + 1), F.coalesce("id", F.lit(".")), "ref", join(F.col("alts"), ",", "."), F.coalesce(F.col("qual").cast("string"), F.lit(".")), join(F.col("filters"), ";", "."), join(entries, ";", ".")]
    if samples:
        fields += [F.array_join(keys, ":"), F.array_join(values, "\t")]
    lines = records.join(contig_order, "contig").select(row_text(fields, ".").alias("value"), "rank", "pos")
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    write_text(ordered_lines(lines, [*header, "\t".join(columns)], ["rank", "pos"]), path)


def segment_records(segments: DataFrame) -> DataFrame:
    """Segments (contig, start, stop, tcn, mcn, status, flags) as VCF records."""
    alt = F.when(F.col("status").isin("gain", "gainLOH"), "<DUP>").when(F.col("status") == "loss", "<DEL>").when(F.col("status") == "cnLOH", "<LOH>")
    text = lambda c: F.array(F.col(c).cast("string"))
    gt = F.when(F.col("status") == "ref", "0/0").when(F.col("tcn") == 0, "1/1").otherwise("0/1")
    return segments.select(
        "contig", F.col("start").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit("N").alias("ref"), F.when(alt.isNotNull(), F.array(alt)).otherwise(F.array().cast("array<string>")).alias("alts"), F.lit(None).cast("double").alias("qual"), F.split("flags", ";").alias("filters"),
        F.create_map(F.lit("END"), text("stop"), F.lit("SVLEN"), F.array((F.col("stop") - F.col("start")).cast("string")), F.lit("SVTYPE"), F.array(F.lit("CNV"))).alias("info"),
        F.array(F.struct(F.lit("sample").alias("name"), F.create_map(F.lit("GT"), F.array(gt), F.lit("CN"), text("tcn"), F.lit("MCN"), text("mcn")).alias("format"))).alias("samples"),
    )


def fastq(df: DataFrame, path: str, sample: str | None = None, compression: str = "gzip") -> None:
    """FASTQ text of name, seq, qual; a folder per ``sample`` if that is given."""
    value = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    lines = df.select(value.alias("value"), *([sample] if sample else []))
    writer = lines.write.option("compression", compression)
    (writer.partitionBy(sample) if sample else writer).text(path)


def bedgraph(df: DataFrame, path: str, value: str) -> None:
    bed(df, path, [value])


def session_xml(tracks: list[str], genome: str = "hg38") -> str:
    """A viewer session of the given track files."""
    from xml.sax.saxutils import quoteattr

    resources = "".join(f"<Resource path={quoteattr(t)}/>" for t in tracks)
    return f'<?xml version="1.0" encoding="UTF-8"?><Session genome={quoteattr(genome)} version="8"><Resources>{resources}</Resources></Session>'


def histogram(df: DataFrame, path: str, value: str, count: str, most: int, metadata: dict[str, str]) -> None:
    """A histogram's rows up to ``most`` and the rest as one row ``most``+, in order of the value."""
    folded = F.least(F.col(value), F.lit(most + 1))
    rows = df.groupBy(folded.alias("at")).agg(F.sum(count).alias(count))
    named = rows.select(F.when(F.col("at") > most, F.lit(f"{most}+")).otherwise(F.col("at").cast("string")).alias(value), count, "at")
    lines = named.withColumn("value", row_text([value, count])).select("value", "at")
    write_text(ordered_lines(lines, [f"##{k}={v}" for k, v in metadata.items()] + [f"{value}\t{count}"], ["at"]), path)


def empty_like(df: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """A table's header alone, so that whatever reads it finds no rows."""
    tsv(df.limit(0), path, metadata, [df.columns[0]])


def metrics(rows: DataFrame, path: str) -> None:
    """metric, value rows as a table, by name."""
    tsv(rows.select("metric", "value"), path, {}, ["metric"])


def sam(alignments: DataFrame, path: str, lengths: DataFrame) -> None:
    """SAM text of qname, flag, contig, pos, mapq, cigar, seq, qual and tags, by contig and position, unplaced ones last."""
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.when(e["value"].rlike("^-?[0-9]+$"), ":i:").otherwise(":Z:"), e["value"]))
    fields = ["qname", "flag", F.coalesce("contig", F.lit("*")), F.col("pos") + 1, "mapq", "cigar", F.lit("*"), F.lit(0), F.lit(0), "seq", "qual"]
    value = F.concat_ws("\t", row_text(fields, "*"), F.when(F.size("tags") > 0, F.array_join(tags, "\t")))
    order = F.coalesce("rank", F.lit(1 << 40))
    lines = alignments.join(lengths.select("contig", "rank"), "contig", "left").select(value.alias("value"), order.alias("rank"), "pos", "qname")
    head = [f"@SQ\tSN:{r['contig']}\tLN:{r['length']}" for r in lengths.orderBy("rank").collect()]  # a line per contig
    write_text(ordered_lines(lines, ["@HD\tVN:1.6\tSO:coordinate", *head], ["rank", "pos", "qname"]), path)


def sheet(rows: DataFrame, path: str) -> None:
    """A sample sheet: sample_name, sample_sid."""
    rows.select("sample_name", "sample_sid").write.csv(path, header=True)
