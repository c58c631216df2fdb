"""postlens: post-stream analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a Column
expression in :mod:`postlens.functions`).  Nothing is collected to the driver;
small dimension tables (weights, aliases, lexicons) are the only broadcast
sides and each of them is size-checked before it is broadcast.
"""

from postlens.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
