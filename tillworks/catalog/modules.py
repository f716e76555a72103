"""Imports every query module, which registers its queries."""

from tillworks.catalog import report_queries  # noqa: F401
from tillworks.catalog import scalar_queries  # noqa: F401
from tillworks.catalog import coupon_queries  # noqa: F401
from tillworks.catalog import board_queries  # noqa: F401
from tillworks.catalog import access_queries  # noqa: F401
from tillworks.catalog import job_queries  # noqa: F401
from tillworks.catalog import stream_queries  # noqa: F401
from tillworks.catalog import desk_queries  # noqa: F401
