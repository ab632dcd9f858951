"""Query catalogue shared by ``__spark_entry__`` and ``bench.py``.

Every query reads the whole input tables (through the fixture views) so its work
grows with them.  Queries without an oracle get a rows-only check.
"""

from __future__ import annotations

from . import q_telemetry  # noqa: F401  (registers queries)
from . import q_text  # noqa: F401
from . import q_training  # noqa: F401
from . import q_routing  # noqa: F401
from . import q_stream  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
