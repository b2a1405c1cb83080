"""Instants from dates written in several layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_S = r"[ /.\-]"
_D, _Y, _T = r"(\d{2})", r"(\d{4})", r"(\d{2}):(\d{2}):(\d{2})"
# year first, time first, day first, compact; what fits none gives an empty date. An offset, else the Z put behind, ends the text.
_LAYOUTS = (f"{_Y}{_S}{_D}{_S}{_D}[ T]+{_T}", f"{_T} {_Y}{_S}{_D}{_S}{_D}", f"{_D}{_S}{_D}{_S}{_Y}[ T]+{_T}", rf"{_Y}{_D}{_D}T{_D}{_D}{_D}")
_READ = rf"(?s)^(?:(?:{'|'.join(_LAYOUTS)}).*?([+\-]\d{{2}}:\d{{2}}(?=Z$)|Z$)Z?|.*)$"
_WRITTEN = "$1$10$15$19-$2$11$14$20-$3$12$13$21T$4$7$16$22:$5$8$17$23:$6$9$18$24$25"


def instant(c: Column) -> Column:
    """The timestamp a text names, NULL where it names none (or a day that does not exist).

    Read: year first with blank, dash, slash or dot (T or blank before the time), time before the
    date, day first, and the compact form; an offset at the end is honoured, else the time is UTC.
    """
    return F.regexp_replace(F.concat(F.upper(F.trim(c)), F.lit("Z")), _READ, _WRITTEN).try_cast("timestamp")
