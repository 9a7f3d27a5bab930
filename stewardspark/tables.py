"""The ten governance tables of one source, read only when asked for."""

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame


class Tables(Mapping):
    """Table name -> DataFrame. A table is planned on first use and then kept."""

    def __init__(self, loaders: Mapping[str, Callable[[], DataFrame]]):
        self._loaders = dict(loaders)
        self._loaded: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, **frames: DataFrame) -> "Tables":
        return cls({name: lambda df=df: df for name, df in frames.items()})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            self._loaded[name] = self._loaders[name]()
        return self._loaded[name]

    def __iter__(self):
        return iter(self._loaders)

    def __len__(self) -> int:
        return len(self._loaders)
