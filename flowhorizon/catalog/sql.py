"""SQL building blocks of the DuckDB side: each name is a CTE body, ``with_`` strings them together."""

from __future__ import annotations

from ..functions.lookups import LABEL_TABLES

W_US, S_US, LENGTH, AHEAD = 21_600_000_000, 10_800_000_000, 10, 3

_labels = ", ".join(
    f"('{raw}', '{c}', '{s}', '{k}')" for raw, (c, s, k) in LABEL_TABLES["cic_ids2017"].items()
)

CTES: dict[str, tuple[list[str], str]] = {
    "label_map": ([], f"SELECT * FROM (VALUES {_labels}) t(dataset_label, cls, stg, conf)"),
    "flows": (
        [],
        """SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value, k,
        'h' || user_id AS source_ip, 'h' || ((user_id + k) % 150) AS destination_ip,
        1024 + k AS source_port, k AS destination_port,
        CASE WHEN k % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol, value / 10 AS flow_duration,
        CAST(1 + k % 20 AS DOUBLE) AS packet_count, value * 100 AS byte_count, CAST(k % 3 AS DOUBLE) AS syn_count,
        CASE WHEN event_type = 'error' AND value >= 80 THEN 'DoS Hulk'
             WHEN event_type = 'signup' AND value >= 120 THEN 'FTP-Patator' ELSE 'BENIGN' END AS dataset_label
        FROM (SELECT *, CAST(props->>'k' AS INT) AS k FROM events)""",
    ),
    "labelled": (["flows", "label_map"], "SELECT * FROM flows JOIN label_map USING (dataset_label)"),
    "features": (
        ["labelled"],
        """SELECT *, packet_count / greatest(flow_duration, 1e-6) AS pps, byte_count / greatest(flow_duration, 1e-6) AS bps,
        byte_count / greatest(packet_count, 1.0) AS bpp, us - (SELECT min(us) FROM flows) AS off FROM labelled""",
    ),
    "member": (
        ["features"],
        f"""SELECT *, source_ip AS host_id, unnest(generate_series(
        CASE WHEN off < {W_US} THEN 0 ELSE (off - {W_US}) // {S_US} + 1 END, off // {S_US})) AS k_win FROM features""",
    ),
    "port_counts": (
        ["member"],
        "SELECT host_id, k_win, destination_port, count(*) AS c FROM member GROUP BY ALL",
    ),
    "entropy": (
        ["port_counts"],
        """SELECT host_id, k_win, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0.0) AS port_entropy
        FROM port_counts GROUP BY ALL""",
    ),
    "burst": (
        ["member"],
        """SELECT host_id, k_win, CAST(max(c) AS DOUBLE) AS burst FROM (
        SELECT host_id, k_win, date_trunc('second', ts) AS sec, count(*) AS c FROM member GROUP BY ALL) GROUP BY ALL""",
    ),
    "class_pick": (
        ["member"],
        """SELECT host_id, k_win, first(cls ORDER BY c DESC, cls) AS dominant_class FROM (
        SELECT host_id, k_win, cls, count(*) AS c FROM member WHERE cls <> 'Benign' GROUP BY ALL) GROUP BY ALL""",
    ),
    "stage_pick": (
        ["member"],
        """SELECT host_id, k_win, first(stg ORDER BY c DESC, stg) AS dominant_stage FROM (
        SELECT host_id, k_win, stg, count(*) AS c FROM member WHERE stg <> 'Benign' GROUP BY ALL) GROUP BY ALL""",
    ),
    "raw_pick": (
        ["member"],
        """SELECT host_id, k_win, first(dataset_label ORDER BY c DESC, dataset_label) AS dominant_dataset_label FROM (
        SELECT host_id, k_win, dataset_label, count(*) AS c FROM member GROUP BY ALL) GROUP BY ALL""",
    ),
    "stage_text": (
        ["member"],
        """SELECT host_id, k_win, '{' || string_agg('"' || stg || '": ' || c, ', ' ORDER BY stg) || '}' AS stage_distribution
        FROM (SELECT host_id, k_win, stg, count(*) AS c FROM member GROUP BY ALL) GROUP BY ALL""",
    ),
    "win": (
        ["member", "entropy", "burst", "class_pick", "stage_pick", "raw_pick", "stage_text"],
        f"""SELECT m.host_id, m.k_win AS window_idx, make_timestamp((SELECT min(us) FROM flows) + m.k_win * {S_US}) AS window_start,
        make_timestamp((SELECT min(us) FROM flows) + m.k_win * {S_US} + {W_US}) AS window_end, m.* EXCLUDE (host_id, k_win),
        least(greatest(syn_count_sum / greatest(packet_count_sum, 1.0), 0.0), 1.0) AS syn_ratio,
        unique_destination_ips / flow_count AS communication_fan_out,
        port_entropy AS destination_port_entropy, burst AS connection_burst_max,
        attacks / flow_count AS attack_flow_ratio, 1.0 - attacks / flow_count AS benign_flow_ratio,
        CASE WHEN attacks > 0 THEN 1 ELSE 0 END AS attack_present,
        coalesce(dominant_class, 'Benign') AS dominant_class, coalesce(dominant_stage, 'Benign') AS dominant_stage,
        dominant_dataset_label, stage_distribution,
        CASE WHEN attacks > 0 THEN 'inferred' ELSE 'ground_truth' END AS label_confidence
        FROM (SELECT host_id, k_win, count(*) AS flow_count, sum(packet_count) AS packet_count_sum,
          avg(packet_count) AS packet_count_mean, sum(byte_count) AS byte_count_sum, avg(byte_count) AS byte_count_mean,
          avg(flow_duration) AS duration_mean, sum(flow_duration) AS duration_total,
          count(DISTINCT destination_ip) AS unique_destination_ips,
          count(DISTINCT destination_port) AS unique_destination_ports, count(DISTINCT source_port) AS unique_source_ports,
          avg(pps) AS packets_per_second_mean, avg(bps) AS bytes_per_second_mean, avg(bpp) AS bytes_per_packet_mean,
          sum(syn_count) AS syn_count_sum, count(*) FILTER (WHERE cls <> 'Benign') AS attacks
          FROM member GROUP BY ALL) m
        JOIN entropy USING (host_id, k_win) JOIN burst USING (host_id, k_win) JOIN raw_pick USING (host_id, k_win)
        JOIN stage_text USING (host_id, k_win)
        LEFT JOIN class_pick USING (host_id, k_win) LEFT JOIN stage_pick USING (host_id, k_win)""",
    ),
    "numbered": (
        ["win"],
        "SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY window_idx) - 1 AS idx FROM win",
    ),
    "runs": (
        ["numbered"],
        f"""SELECT b.host_id, b.idx - {LENGTH - 1} AS i, a.window_start AS seq_start_time, b.window_end AS seq_end_time,
        b.window_idx AS last_k, b.idx AS last_idx, b.attack_flow_ratio AS last_attack_ratio, b.flow_count AS last_flow_count,
        sum(m.flow_count) AS flows_sum, max(m.attack_present) AS attacked, sum(m.destination_port_entropy) AS entropy_sum,
        sum(m.packets_per_second_mean) AS pps_sum
        FROM numbered b JOIN numbered a ON a.host_id = b.host_id AND a.idx = b.idx - {LENGTH - 1}
        JOIN numbered m ON m.host_id = b.host_id AND m.idx BETWEEN b.idx - {LENGTH - 1} AND b.idx
        GROUP BY ALL""",
    ),
    "seqs": (
        ["runs", "numbered"],
        """SELECT r.host_id || '_seq_' || r.i AS sequence_id, r.*, t.window_start AS target_window_start,
        t.window_end AS target_window_end, t.window_idx AS target_k, t.attack_present AS target_attack_present,
        t.dominant_class AS target_dominant_class, t.dominant_stage AS target_dominant_stage,
        t.stage_distribution AS target_stage_distribution, t.label_confidence AS target_label_confidence,
        t.flow_count AS target_flow_count, (t.attack_present = 1 AND r.attacked = 0) AS target_is_onset
        FROM runs r JOIN numbered t ON t.host_id = r.host_id AND t.window_start > r.seq_end_time
        QUALIFY row_number() OVER (PARTITION BY r.host_id, r.i ORDER BY t.window_idx) = 1""",
    ),
    "cuts": (
        ["seqs"],
        """SELECT quantile_cont(epoch_us(target_window_end), 0.6) AS c1, quantile_cont(epoch_us(target_window_end), 0.8) AS c2
        FROM seqs""",
    ),
    "split": (
        ["seqs", "cuts"],
        """SELECT s.*, CASE WHEN epoch_us(seq_start_time) >= c2 THEN 'test'
        WHEN epoch_us(seq_start_time) >= c1 AND epoch_us(target_window_end) <= c2 THEN 'val'
        WHEN epoch_us(target_window_end) <= c1 THEN 'train' ELSE 'boundary_excluded' END AS split FROM seqs s, cuts""",
    ),
    "scores": (
        [],
        """SELECT 's' || l_suppkey AS host_id, 'stage-' || (l_partkey % 5) AS cls,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
        ((l_orderkey * 37 + l_partkey * 13 + l_linenumber * 101) % 797 + CASE WHEN l_returnflag = 'R' THEN 204 ELSE 0 END)
          / 1001.0 AS p,
        l_linestatus = 'O' AS is_onset, l_shipdate AS target_window_start,
        CASE WHEN l_orderkey % 5 < 3 THEN 'train' WHEN l_orderkey % 5 = 3 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT * REPLACE (l_orderkey AS l_orderkey) FROM lineitem)""",
    ),
}
# DuckDB divides decimals exactly, so the score is cast once
CTES["scores"] = ([], CTES["scores"][1].replace("/ 1001.0 AS p", "/ CAST(1001 AS DOUBLE) AS p"))


def with_(*names: str, **more: str) -> str:
    """``WITH`` clause holding the named blocks and what they need, then the extra ones given."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for need in CTES[name][0]:
                add(need)
            done.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in done] + [f"{n} AS ({body})" for n, body in more.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" if any("RECURSIVE" in b for b in more.values()) else "WITH " + ",\n".join(
        parts
    ) + "\n"


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)
