"""Imports every family of registered queries (fills ``registry``)."""

from . import consensus_queries  # noqa: F401
from . import board_queries  # noqa: F401
from . import progress_queries  # noqa: F401
from . import state_queries  # noqa: F401
from . import ingest_queries  # noqa: F401
from . import lookup_queries  # noqa: F401
from . import validate_queries  # noqa: F401
from . import stream_queries  # noqa: F401
from . import storage_queries  # noqa: F401
from . import incremental_queries  # noqa: F401
