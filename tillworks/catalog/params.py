"""Parameters of the registered queries: times and ranges inside the test data."""

from datetime import date, datetime

from tillworks.config import ShopConfig
from tillworks.functions.timeutil import DayRange

SHOP = ShopConfig()

AS_OF = datetime(1998, 7, 1, 12, 0, 0)
EVENTS_AS_OF = datetime(2024, 1, 20, 12, 0, 0)
ALL_DAYS = DayRange(date(1995, 1, 1), date(2001, 12, 31))
ONE_YEAR = DayRange.resolve(date(1998, 1, 1), date(1998, 12, 31))

# The same values for the check text.
AS_OF_SQL = "TIMESTAMP '1998-07-01 12:00:00'"
EVENTS_AS_OF_SQL = "TIMESTAMP '2024-01-20 12:00:00'"
ALL_DAYS_SQL = "created_at >= TIMESTAMP '1994-12-31 18:30:00' AND created_at < TIMESTAMP '2001-12-31 18:30:00'"
ONE_YEAR_SQL = "created_at >= TIMESTAMP '1997-12-31 18:30:00' AND created_at < TIMESTAMP '1998-12-31 18:30:00'"
LOCAL = "(created_at + INTERVAL '330' MINUTE)"
DAY = f"CAST({LOCAL} AS DATE)"
