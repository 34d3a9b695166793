"""residuum — context-residual analytics on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) whose work is planned by Catalyst and executed on the
cluster. See README.md for the operator map.
"""

from residuum.session import build_session, shared_path

__all__ = ["build_session", "shared_path"]
