"""Jobs bound to the fixture tables; importing this package fills the registry."""

from . import registry  # noqa: F401
from . import tracker_jobs  # noqa: F401
from . import report_jobs  # noqa: F401
from . import merge_jobs  # noqa: F401
from . import dedup_jobs  # noqa: F401
from . import scan_jobs  # noqa: F401
from . import posting_jobs  # noqa: F401
from . import queue_jobs  # noqa: F401
from . import page_jobs  # noqa: F401
from . import doc_jobs  # noqa: F401
from . import payload_jobs  # noqa: F401
from . import misc_jobs  # noqa: F401
from . import stream_sink_jobs  # noqa: F401
from . import extra_jobs  # noqa: F401

from .registry import ORACLES, QUERIES  # noqa: F401
