"""Vocabularies and lookup tables, plus the small DataFrames built from them.

The tables here are literals of a few dozen rows at most, which is why they may be broadcast.
"""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# --- fixed values -------------------------------------------------------------------------

STAGE_ORDER = [
    "Benign",
    "Reconnaissance",
    "Initial Access",
    "Lateral Movement",
    "Command and Control",
    "Exfiltration",
    "Impact",
]

STAGE_SEVERITY = {
    "Benign": 0,
    "Reconnaissance": 30,
    "Initial Access": 55,
    "Lateral Movement": 70,
    "Command and Control": 85,
    "Exfiltration": 95,
    "Impact": 90,
}

# dataset -> raw label -> (attack class, attack stage, confidence)
LABEL_TABLES = {
    "cic_ids2017": {
        "BENIGN": ("Benign", "Benign", "ground_truth"),
        "PortScan": ("Reconnaissance", "Reconnaissance", "inferred"),
        "FTP-Patator": ("Brute Force", "Initial Access", "inferred"),
        "SSH-Patator": ("Brute Force", "Initial Access", "inferred"),
        "Web Attack – Brute Force": ("Web Attack", "Initial Access", "inferred"),
        "Web Attack – XSS": ("Web Attack", "Initial Access", "inferred"),
        "Web Attack – Sql Injection": ("Web Attack", "Initial Access", "inferred"),
        "Infiltration": ("Infiltration", "Lateral Movement", "inferred"),
        "Heartbleed": ("Heartbleed", "Lateral Movement", "inferred"),
        "Bot": ("Botnet", "Command and Control", "inferred"),
        "DoS": ("Denial of Service", "Impact", "inferred"),
        "DoS slowloris": ("Denial of Service", "Impact", "inferred"),
        "DoS Slowhttptest": ("Denial of Service", "Impact", "inferred"),
        "DoS Hulk": ("Denial of Service", "Impact", "inferred"),
        "DoS GoldenEye": ("Denial of Service", "Impact", "inferred"),
        "DDoS": ("Denial of Service", "Impact", "inferred"),
    },
    "ctu_13": {
        "Botnet": ("Botnet", "Command and Control", "inferred"),
        "Normal": ("Benign", "Benign", "ground_truth"),
        "Background": ("Benign", "Benign", "inferred"),
    },
    "optc": {
        "Malicious": ("APT", "Lateral Movement", "inferred"),
        "Benign": ("Benign", "Benign", "inferred"),
    },
    "lanl_2015": {
        "RedTeam": ("APT", "Lateral Movement", "inferred"),
        "RedTeamSource": ("APT", "Command and Control", "inferred"),
        "Benign": ("Benign", "Benign", "inferred"),
    },
}

# stage -> (tactic id, tactic name, [(technique id, technique name)]), public MITRE ATT&CK ids
MITRE_TACTICS = {
    "Benign": (None, None, []),
    "Reconnaissance": ("TA0043", "Reconnaissance", [("T1595", "Active Scanning")]),
    "Initial Access": (
        "TA0001",
        "Initial Access",
        [("T1110", "Brute Force"), ("T1190", "Exploit Public-Facing Application")],
    ),
    "Lateral Movement": ("TA0008", "Lateral Movement", [("T1210", "Exploitation of Remote Services")]),
    "Command and Control": ("TA0011", "Command and Control", [("T1071", "Application Layer Protocol")]),
    "Exfiltration": ("TA0010", "Exfiltration", [("T1041", "Exfiltration Over C2 Channel")]),
    "Impact": ("TA0040", "Impact", [("T1498", "Network Denial of Service")]),
}

PROTOCOL_NAMES = {
    "flowmeter": {"6": "TCP", "17": "UDP", "0": "HOPOPT", "1": "ICMP"},
    "packets": {"6": "TCP", "17": "UDP", "1": "ICMP", "58": "ICMPv6"},
    "ecar": {"6": "TCP", "17": "UDP", "1": "ICMP", "58": "ICMPV6"},
    "authlog": {"6": "TCP", "17": "UDP", "1": "ICMP"},
}

# the numeric window features a sequence carries, in order
WINDOW_FEATURES = [
    "flow_count", "packet_count_sum", "packet_count_mean", "byte_count_sum", "byte_count_mean",
    "duration_mean", "packets_per_second_mean", "bytes_per_second_mean", "bytes_per_packet_mean",
    "packet_size_mean", "packet_size_std_mean", "inter_arrival_mean",
    "syn_count_sum", "ack_count_sum", "rst_count_sum", "fin_count_sum", "psh_count_sum",
    "syn_ratio", "ack_ratio", "rst_ratio", "fin_ratio", "psh_ratio",
    "tcp_window_size_mean", "unique_destination_ips", "unique_destination_ports",
    "unique_source_ports", "destination_port_entropy", "connection_burst_max",
    "attack_flow_ratio", "benign_flow_ratio",
]
LABEL_FEATURES = ["attack_flow_ratio", "benign_flow_ratio"]  # computed from labels, never model inputs
MODEL_FEATURES = [f for f in WINDOW_FEATURES if f not in LABEL_FEATURES]
LOG_FEATURES = [
    "flow_count", "packet_count_sum", "byte_count_sum", "syn_count_sum", "ack_count_sum",
    "rst_count_sum", "fin_count_sum", "psh_count_sum", "unique_destination_ips",
    "unique_destination_ports", "unique_source_ports", "connection_burst_max",
]

THRESHOLD_GRID = [0.01, 0.05, 0.1, 0.2, 0.3, 0.5]
RISK_WEIGHTS = {
    "attack_probability": 0.4,
    "stage_severity": 0.25,
    "prediction_confidence": 0.15,
    "abnormality_score": 0.1,
    "recent_attack_history": 0.1,
}
UNCERTAIN = "UNCERTAIN"
GENESIS = "0" * 64

# --- tables and column lookups ------------------------------------------------------------


def map_column(values: dict) -> Column:
    """A literal map column; use ``map_column(d)[key]`` as a lookup."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A fixed table as one literal in the plan: no Python RDD, no extra job."""
    names = [f.name for f in T.StructType.fromDDL(ddl)]
    text = json.dumps([dict(zip(names, r)) for r in rows], ensure_ascii=False)
    parsed = F.from_json(F.lit(text), T.ArrayType(T.StructType.fromDDL(ddl)))
    return spark.range(1).select(F.inline(parsed))


def label_table(spark: SparkSession, dataset: str) -> DataFrame:
    if dataset not in LABEL_TABLES:
        raise KeyError(f"no label table for dataset {dataset!r}; have {sorted(LABEL_TABLES)}")
    rows = [(raw, *target) for raw, target in LABEL_TABLES[dataset].items()]
    return literal_table(
        spark,
        rows,
        "dataset_label string, normalized_attack_class string, attack_stage string, label_confidence string",
    )


def mitre_table(spark: SparkSession) -> DataFrame:
    rows = [(s, t, n, [{"id": i, "name": m} for i, m in k]) for s, (t, n, k) in MITRE_TACTICS.items()]
    return literal_table(
        spark,
        rows,
        "stage string, tactic_id string, tactic_name string, techniques array<struct<id:string,name:string>>",
    )


def stage_rank(stage: Column) -> Column:
    """Position of a stage in the canonical order, from 0; NULL when unknown."""
    pos = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), stage)
    return F.when(pos > 0, (pos - 1).cast("int"))
