"""Decoded packets to bidirectional flows.

A flow ends on an idle gap or a RST, wherever it began; those cuts are found with windows over time spans with a halo and
give stretches. Inside a stretch the active timeout and a close by FIN of both sides depend on where the flow
began: each packet learns where a flow that began there would end, from ordered scans, and the flows are the packets
reached from the first one (:mod:`flowhorizon.plans.jumps`), block by block. Flow measures are ordinary aggregates
per side; which side is forward is known when they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import protocol_name
from ..plans.jumps import reached
from ..plans.scan import join_keys, row_index, running, with_time_halo
from ..schema import coerce_flows
from ..sinks.tables import stage

PACKET_DDL = (
    "ts double, src string, dst string, sport int, dport int, proto int, payload_len int, ttl int, "
    "flags string, window int, seq bigint"
)
FLAG_LETTERS = {"syn": "S", "ack": "A", "rst": "R", "fin": "F", "psh": "P", "urg": "U"}
KEY = ["proto", "ep_a", "ep_b"]
UNLABELED = "UNLABELED"


def conversation_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free endpoint pair; ``order_no`` breaks ties of equal timestamps."""
    def end(ip, port):
        return F.struct(F.col(ip).alias("ip"), F.coalesce(F.col(port), F.lit(-1)).alias("port"))

    a, b = end("src", "sport"), end("dst", "dport")
    if "order_no" not in packets.columns:
        packets = packets.withColumn("order_no", F.lit(0).cast("bigint"))
    return packets.withColumns(
        {
            "ep_a": F.when(a <= b, a).otherwise(b),
            "ep_b": F.when(a <= b, b).otherwise(a),
            "from_a": a <= b,
        }
    )


ORDER = ["ts", "order_no", "src", "seq", "payload_len", "flags"]
SEGMENT_SECONDS = 900


def split_hard(keyed: DataFrame, idle_timeout: float, segment_seconds: float = SEGMENT_SECONDS) -> DataFrame:
    """Add ``burst``, the number of the packet's stretch in its conversation: a new one begins behind an idle gap and
    behind a RST; and ``_prev``, the time of the stretch's packet before.

    Both depend on the packet before, if it is within ``idle_timeout``, which a time halo answers without a
    join; numbering the stretches is one segmented running sum.
    """
    back = round(idle_timeout * 1_000_000)
    span = max(round(segment_seconds * 1_000_000), 8 * back)
    halo = with_time_halo(keyed, "_us", back, span)
    w = W.partitionBy(*KEY, "_span").orderBy(*ORDER)
    gap = F.col("ts") - F.lag("ts").over(w)
    ended = (F.col("proto") == 6) & F.contains(F.coalesce("flags", F.lit("")), F.lit("R"))
    cut = F.coalesce((gap > idle_timeout) | F.lag(ended).over(w), F.lit(True))
    cut = halo.withColumns({"_cut": cut.cast("bigint"), "_prev": F.when(~cut, F.lag("ts").over(w))}).filter("_own")
    slim = cut.drop("_span", "_own")
    segment = F.floor(F.col("ts") / segment_seconds).cast("bigint")
    numbered = running(stage(slim, "packets"), KEY, ORDER, [("_seg", segment)], {"_b": ("sum", "_cut")})
    return numbered.withColumn("burst", F.col("_b") + F.col("_cut")).drop("_cut", "_b")


RUN = ["proto", "ai", "ap", "bi", "bp", "burst"]
SEGMENT_ROWS = 4096


def flow_ends(rows: DataFrame, active_us: int) -> DataFrame:
    """(stretch, ``_i``, ``_next``): the packet behind the flow that begins at packet ``_i``.

    That is the first one later than the active timeout, or the one behind the close if both sides have sent FIN from
    ``_i`` on. The next FIN of a side is a running minimum from the end; how many packets lie within the timeout is a
    running count over packets and questions in one order.
    """
    side = lambda own: F.when(F.col("_fin") & (F.col("from_a") == F.lit(own)), F.col("_i"))
    fins = rows.withColumns({"_fa": side(True), "_fb": side(False), "_back": -F.col("_i")})
    segment = F.floor(F.col("_back") / SEGMENT_ROWS)
    ahead = running(fins, RUN, ["_back"], [("_seg", segment)], {"_na": ("min", "_fa"), "_nb": ("min", "_fb")})
    close = F.least("_fa", "_na"), F.least("_fb", "_nb")
    both = F.when(close[0].isNotNull() & close[1].isNotNull(), F.greatest(*close) + 1).alias("_closed")
    known = stage(ahead.select(*RUN, "_i", "_us", both), "teardown")
    none = F.lit(None).cast("bigint")
    packets = known.select(*RUN, "_us", F.lit(0).alias("_kind"), none.alias("_i"), none.alias("_closed"), F.lit(1).cast("bigint").alias("_one"))
    asks = known.select(*RUN, (F.col("_us") + active_us).alias("_us"), F.lit(1).alias("_kind"), "_i", "_closed", F.lit(0).cast("bigint").alias("_one"))
    span = F.floor(F.col("_us") / (SEGMENT_SECONDS * 1_000_000))
    met = running(packets.union(asks), RUN, ["_us", "_kind", "_i"], [("_seg", span)], {"_within": ("sum", "_one")})
    return met.filter("_kind = 1").select(*RUN, "_i", F.least("_within", "_closed").alias("_next"))


def number_flows(bursts: DataFrame, active_timeout: float) -> DataFrame:
    """Add ``flow_no`` inside each (conversation, stretch).

    Stretches that cannot be cut again (within the active timeout, not closed by FIN of both sides) keep number 0; this
    holds for almost all traffic that is not TCP.
    """
    active = round(active_timeout * 1_000_000)
    flat = bursts.withColumns(
        {
            "ai": F.col("ep_a.ip"), "ap": F.col("ep_a.port"), "bi": F.col("ep_b.ip"), "bp": F.col("ep_b.port"),
            "_fin": (F.col("proto") == 6) & F.contains(F.coalesce("flags", F.lit("")), F.lit("F")),
        }
    )
    per = flat.groupBy(*RUN).agg(
        (F.max("_us") - F.min("_us")).alias("_len"),
        F.count_if(F.col("_fin") & F.col("from_a")).alias("_a"), F.count_if(F.col("_fin") & ~F.col("from_a")).alias("_b"),
    )
    again = (F.col("_len") > active) | ((F.col("_a") > 0) & (F.col("_b") > 0))
    joined = stage(join_keys(flat, per.select(*RUN, again.alias("_again")), RUN), "stretches")
    plain = joined.filter(~F.col("_again")).withColumn("flow_no", F.lit(0).cast("bigint"))
    segment = F.floor(F.col("ts") / SEGMENT_SECONDS).cast("bigint")
    rest = stage(row_index(joined.filter("_again"), RUN, ORDER, segment, "_i"), "numbered")
    begins = reached(flow_ends(rest.select(*RUN, "_i", "_us", "_fin", "from_a"), active), RUN)
    marked = join_keys(rest, begins.withColumn("_begin", F.lit(1).cast("bigint")), [*RUN, "_i"], "left")
    place = F.floor(F.col("_i") / SEGMENT_ROWS)
    before = running(marked.fillna(0, ["_begin"]), RUN, ["_i"], [("_seg", place)], {"_n": ("sum", "_begin")})
    numbered = before.withColumn("flow_no", F.col("_n") + F.col("_begin") - 1)
    numbered = numbered.withColumn("_prev", F.when(F.col("_begin") == 0, F.col("_prev")))
    return plain.unionByName(numbered.select(*plain.columns))


def packets_to_flows(packets: DataFrame, idle_timeout: float = 120.0, active_timeout: float = 3600.0) -> DataFrame:
    """Canonical flows. The first packet sets the forward direction; a flow ends on an idle gap,
    after the active timeout, on RST, or once FIN was seen from both sides. The active timeout is told to the microsecond."""
    if idle_timeout <= 0 or active_timeout <= 0:
        raise ValueError("timeouts must be positive")
    keyed = conversation_key(packets).withColumn("_us", F.round(F.col("ts") * 1e6).cast("bigint"))
    numbered = number_flows(split_hard(keyed, idle_timeout), active_timeout)
    flow = [*RUN, "flow_no"]
    size, a = F.col("payload_len").cast("double"), F.col("from_a")
    rows = stage(numbered.withColumn("_iat", (F.col("ts") - F.col("_prev")) * 1e6), "flow-packets")
    flags = F.coalesce("flags", F.lit(""))
    window = lambda side: F.min(F.when(side & F.col("window").isNotNull(), F.struct(*ORDER, "window")))
    total = F.count(F.lit(1)).cast("double")
    found = rows.groupBy(*flow).agg(
        F.min(F.struct(*ORDER, "sport", "dst", "dport", "from_a")).alias("_head"),
        F.min("ts").alias("_t"),
        (F.max("ts") - F.min("ts")).alias("flow_duration"),
        total.alias("packet_count"),
        F.sum(size).alias("byte_count"),
        F.count_if(a).cast("double").alias("_pa"),
        F.coalesce(F.sum(F.when(a, size)), F.lit(0.0)).alias("_ba"),
        F.avg(size).alias("packet_size_mean"),
        F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("packet_size_std"),
        F.min(size).alias("packet_size_min"),
        F.max(size).alias("packet_size_max"),
        F.coalesce(F.avg("_iat"), F.lit(0.0)).alias("inter_arrival_mean"),
        F.coalesce(F.stddev_samp("_iat"), F.lit(0.0)).alias("inter_arrival_std"),
        *[F.sum(F.contains(flags, F.lit(x)).cast("double")).alias(f"{n}_count") for n, x in FLAG_LETTERS.items()],
        window(a).alias("_wa"), window(~a).alias("_wb"),
        F.avg("ttl").alias("ttl_mean"),
        F.when(F.count("ttl") > 0, F.coalesce(F.stddev_samp("ttl"), F.lit(0.0))).alias("ttl_std"),
    )
    # equal (side, seq, length) segments are counted first: repeats are retransmissions
    segments = rows.filter((F.col("proto") == 6) & (F.col("payload_len") > 0) & F.col("seq").isNotNull())
    segments = segments.groupBy(*flow, "from_a", "seq", "payload_len").agg((F.count(F.lit(1)) - 1).alias("_more"))
    again = segments.groupBy(*flow).agg(F.sum("_more").cast("double").alias("_again"))
    flows = join_keys(found, again, flow, "left")
    forward = F.col("_head.from_a")
    of_side = lambda x, y: F.when(forward, x).otherwise(y)
    packets_b, bytes_b = F.col("packet_count") - F.col("_pa"), F.col("byte_count") - F.col("_ba")
    made = (*flow, "_head", "_t", "_wa", "_wb", "_again", "_pa", "_ba")
    out = flows.select(
        F.timestamp_micros(F.round(F.col("_t") * 1e6).cast("bigint")).alias("timestamp"),
        F.col("_head.src").alias("source_ip"),
        F.col("_head.dst").alias("destination_ip"),
        F.col("_head.sport").alias("source_port"),
        F.col("_head.dport").alias("destination_port"),
        protocol_name(F.col("proto"), "packets").alias("protocol"),
        F.lit(UNLABELED).alias("dataset_label"),
        of_side(F.col("_wa.window"), F.col("_wb.window")).cast("double").alias("tcp_window_size"),
        F.when(F.col("proto") == 6, F.coalesce("_again", F.lit(0.0))).alias("retransmission_count"),
        of_side(F.col("_pa"), packets_b).alias("fwd_packet_count"),
        of_side(packets_b, F.col("_pa")).alias("bwd_packet_count"),
        of_side(F.col("_ba"), bytes_b).alias("fwd_byte_count"),
        of_side(bytes_b, F.col("_ba")).alias("bwd_byte_count"),
        *[c for c in flows.columns if c not in made],
        F.lit("pcap").alias("source_dataset"),
    )
    return coerce_flows(out)
