"""stationflow: station and vehicle availability analytics as PySpark jobs."""

from stationflow.session import build_session

__all__ = ["build_session"]
