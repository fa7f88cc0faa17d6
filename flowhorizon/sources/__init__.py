"""Readers for raw telemetry. Each reader is split in two: ``read_*`` scans files into a raw
DataFrame and ``*_to_flows`` turns such a DataFrame into canonical flows, so the second half also
serves streams and tables."""
