"""stratus: weather analytics expressed as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (usable with
``df.transform``) so Catalyst sees one lazy plan per query and chooses the
physical strategy itself.
"""

from stratus.session import build_session, configure, shared_dir

__all__ = ["build_session", "configure", "shared_dir"]
