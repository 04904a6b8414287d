"""A Python data source that replays a numbered list page by page, as a list service with a cursor would.

Its offset is the cursor: rows already read, and whether the list is exhausted. A restart goes on from the last one.
"""

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

PAGE = 40


class ReplayReader(SimpleDataSourceStreamReader):
    """`rows` rows in pages of PAGE; each has its number and the page it came on."""

    def __init__(self, options: dict):
        self.rows, self.page = int(options.get("rows", 0)), int(options.get("page", PAGE))

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def _slice(self, start: int, end: int) -> Iterator[tuple]:
        return iter([(i, i // self.page + 1, i + 1 == self.rows) for i in range(start, end)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(self.rows, start["offset"] + self.page)
        return self._slice(start["offset"], end), {"offset": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._slice(start["offset"], end["offset"])


class ReplaySource(DataSource):
    """Format `replay`; options rows and page."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "seq long, page long, last boolean"

    def simpleStreamReader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)
