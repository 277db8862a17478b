"""Imports every query family so their keys register (Spark callables + SQL twins)."""

from . import q_features  # noqa: F401
from . import q_ingest  # noqa: F401
from . import q_store  # noqa: F401
from . import q_report  # noqa: F401
from . import q_metrics  # noqa: F401
from . import q_models  # noqa: F401
from . import q_stream  # noqa: F401
