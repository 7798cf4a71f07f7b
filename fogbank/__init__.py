"""Spark operators for hourly station observations and hand-entered phenomenon codes."""

from fogbank.session import build_session, prepare

__all__ = ["build_session", "prepare"]
