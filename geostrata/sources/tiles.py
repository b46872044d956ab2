"""Tiles of a pyramid through a cache that all tasks share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from geostrata.sources.grids import put_file, store

#: Tiles that a task asks the source for at once.
AHEAD = 8


def from_store(template: str) -> Callable[[int, int, int], bytes]:
    """A source of tiles in any store that pyarrow opens, by a path with {z}, {x} and {y}."""

    def fetch(z: int, x: int, y: int) -> bytes:
        system, place = store(template.format(z=z, x=x, y=y))
        with system.open_input_file(place) as f:
            return f.read()

    return fetch


def read_tiles(tiles: DataFrame, cache: str, fetch: Callable[[int, int, int], bytes] | None) -> DataFrame:
    """z, x, y, content and cached (whether the cache had it) of each tile in ``tiles`` (z, x, y), once each.

    A tile that the cache lacks is fetched, ``AHEAD`` of them at a time, and put into the cache whole before its row is
    given; a task that runs again finds it there. Without ``fetch`` (offline) a missing tile is an error that names it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def get(tile: tuple[int, int, int]) -> tuple[bytes, bool]:
            z, x, y = tile
            path = f"{cache.rstrip('/')}/{z}/{x}/{y}.png"
            system, place = store(path)
            if system.get_file_info(place).is_file:
                with system.open_input_file(place) as f:
                    return f.read(), True
            if fetch is None:
                raise FileNotFoundError(f"the cache has no tile {z}/{x}/{y}")
            data = fetch(z, x, y)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            put_file(path, data)
            return data, False

        with ThreadPoolExecutor(AHEAD) as pool:
            for batch in batches:
                keys = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                for i in range(0, len(keys), AHEAD):
                    part = keys[i : i + AHEAD]
                    got = list(pool.map(get, part))
                    columns = [pa.array([k[n] for k in part], pa.int32()) for n in range(3)]
                    yield pa.record_batch([*columns, pa.array([d for d, _ in got], pa.binary()), pa.array([c for _, c in got])], names=["z", "x", "y", "content", "cached"])

    wanted = tiles.selectExpr("cast(z as int) z", "cast(x as int) x", "cast(y as int) y").where("z is not null and x is not null and y is not null").distinct()
    return wanted.mapInArrow(run, "z int, x int, y int, content binary, cached boolean")
