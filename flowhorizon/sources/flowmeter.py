"""CICFlowMeter CSV exports (header row, about 85 columns, windows-1252)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import parse_flow_time, protocol_name, repair_twelve_hour
from ..schema import coerce_flows

# fixed values: normalised header -> canonical column; other headers are never parsed
HEADERS = {
    "source ip": "source_ip",
    "src ip": "source_ip",
    "destination ip": "destination_ip",
    "dst ip": "destination_ip",
    "source port": "source_port",
    "src port": "source_port",
    "destination port": "destination_port",
    "dst port": "destination_port",
    "protocol": "protocol",
    "timestamp": "timestamp",
    "flow duration": "flow_duration",
    "total fwd packets": "fwd_packet_count",
    "total backward packets": "bwd_packet_count",
    "total length of fwd packets": "fwd_byte_count",
    "totlen fwd pkts": "fwd_byte_count",
    "total length of bwd packets": "bwd_byte_count",
    "totlen bwd pkts": "bwd_byte_count",
    "average packet size": "packet_size_mean",
    "packet length mean": "packet_size_mean",
    "pkt len mean": "packet_size_mean",
    "packet length std": "packet_size_std",
    "pkt len std": "packet_size_std",
    "min packet length": "packet_size_min",
    "pkt len min": "packet_size_min",
    "max packet length": "packet_size_max",
    "pkt len max": "packet_size_max",
    "flow iat mean": "inter_arrival_mean",
    "flow iat std": "inter_arrival_std",
    "syn flag count": "syn_count",
    "ack flag count": "ack_count",
    "rst flag count": "rst_count",
    "fin flag count": "fin_count",
    "psh flag count": "psh_count",
    "urg flag count": "urg_count",
    "init_win_bytes_forward": "tcp_window_size",
    "init win bytes forward": "tcp_window_size",
    "label": "dataset_label",
}

# Spark reads Latin-1; the files are windows-1252, which differs in the range 0x80-0x9F only
_C1 = [i for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore")]
LATIN, WINDOWS = "".join(map(chr, _C1)), bytes(_C1).decode("cp1252")


def read_flowmeter(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """All CSV files under a folder as text columns with canonical names, plus ``source_file``.

    Header spelling varies between files, so files are grouped by their header line and each group
    is one scan whose column pruning reaches the parser. Finding the headers reads the first split
    of every file; give ``header`` when all files share one and that pass is skipped.
    """
    if header is not None:
        return _scan(spark, [path], header)
    listing = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .option("encoding", "iso-8859-1")
        .option("header", False)
        .option("quote", "\u0000")
        .option("sep", "\u0001")
        .schema("line string")
        .csv(path)
        .select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        .filter((F.col("start") == 0) & F.lower("line").contains("label") & F.lower("line").contains("protocol"))
    )
    headers = listing.groupBy("file").agg(F.min_by("line", F.length("line")).alias("line")).groupBy("line").agg(
        F.collect_list("file").alias("files")
    )
    parts = [_scan(spark, r["files"], r["line"]) for r in headers.collect()]  # one row per header spelling
    if not parts:
        raise FileNotFoundError(f"no CSV with a Label column under {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _scan(spark: SparkSession, files: list[str], header: str) -> DataFrame:
    names = header.split(",")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    raw = (
        spark.read.option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .option("enforceSchema", True)
        .option("encoding", "iso-8859-1")
        .option("mode", "PERMISSIVE")
        .schema(schema)
        .csv(files)
    )
    wanted: dict[str, list[Column]] = {}
    for i, n in enumerate(names):
        target = HEADERS.get(n.strip().strip('"').lower())
        if target:
            text = F.translate(f"c{i}", LATIN, WINDOWS) if target == "dataset_label" else F.col(f"c{i}")
            wanted.setdefault(target, []).append(text)
    picked = [F.coalesce(*cols).alias(t) if len(cols) > 1 else cols[0].alias(t) for t, cols in wanted.items()]
    return raw.select(*picked, F.col("_metadata.file_name").alias("source_file"))


def flowmeter_to_flows(raw: DataFrame) -> DataFrame:
    """Canonical flows: header rows inside the data dropped, microseconds to seconds, packets and
    bytes summed over both directions (missing counts as 0), 12-hour clock repaired."""
    label = F.col("dataset_label")
    rows = raw.filter(F.coalesce(F.lower(F.trim(label)) != "label", F.lit(True)))

    def number(c):
        return F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")

    def both(a, b):
        return F.coalesce(number(a), F.lit(0.0)) + F.coalesce(number(b), F.lit(0.0))

    flows = rows.withColumns(
        {
            "timestamp": repair_twelve_hour(parse_flow_time(F.col("timestamp"))),
            "protocol": protocol_name(F.col("protocol"), "flowmeter"),
            "flow_duration": number("flow_duration") / 1e6,
            "packet_count": both("fwd_packet_count", "bwd_packet_count"),
            "byte_count": both("fwd_byte_count", "bwd_byte_count"),
            "source_dataset": F.lit("cic_ids2017"),
        }
    )
    return coerce_flows(flows)
