"""loomwork: order, address and collection processing as PySpark DataFrame operators."""

from loomwork.session import build_session, prepare

__all__ = ["build_session", "prepare"]
