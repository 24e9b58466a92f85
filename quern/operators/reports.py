"""Report text and run bookkeeping on the driver, over rows already aggregated."""

from __future__ import annotations

import contextlib
import fcntl
import os
import platform
from datetime import UTC, datetime

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_weights(listed: str) -> list[float]:
    """Numbers between commas; nothing between two commas is no number, and a list without any is an error."""
    found = list(map(float, filter(None, map(str.strip, listed.split(",")))))
    if found:
        return found
    raise ValueError(f"no weight in {listed!r}")


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A table of summary rows; `limit` keeps a detail table from reaching the driver by mistake."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError("too many rows for a report")
    show = lambda v: "" if v is None else ("YES" if v else "NO") if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in got)])


def markdown_report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A report of headed sections, each a table of summary rows or text."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(parts) + "\n"


def experiment_record(folder: str, streets: list[str], records: int, weights: list[float], beam_width: int, decoder: dict, hotwords: dict[str, list[str]]) -> dict:
    """What it takes to run an experiment again: its inputs, settings, hotwords with their counts, and the environment. Each record goes once through the acoustic model."""
    counts = {f"{kind}_hotword_count": len(words) for kind, words in hotwords.items()}
    listed = {f"{kind}_hotwords": words for kind, words in hotwords.items()}
    return {"dataset": folder, "street_count": len(streets), "n_records": records, "acoustic_forwards": records, "weights": weights, "beam_width": beam_width, "decoder_params": decoder, **counts, **listed, "env": environment()}


def fresh_directory(parent: str, stamp: str) -> str:
    """A new folder named by the stamp, with -2, -3 ... where it is taken."""
    for k in range(1, 10_000):
        path = os.path.join(parent, stamp if k == 1 else f"{stamp}-{k}")
        try:
            os.makedirs(path)
            return path
        except FileExistsError:
            continue
    raise FileExistsError(stamp)


def quarantine(rows: DataFrame, bad, folder: str) -> DataFrame:
    """Writes rows that fail and stops the run; gives the rows back where none does."""
    failed = rows.where(bad)
    if failed.limit(1).count():
        failed.withColumn("at", F.current_timestamp()).write.mode("append").json(folder)
        raise ValueError(f"failed rows are in {folder}")
    return rows


def requires(present: list[str], needed: list[str]) -> None:
    missing = sorted(set(needed) - set(present))
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")


def environment() -> dict[str, str]:
    return {"python": platform.python_version(), "system": platform.platform(), "cpus": str(os.cpu_count()), "pyspark": pyspark.__version__, "at": datetime.now(UTC).isoformat(timespec="seconds")}


@contextlib.contextmanager
def single_writer(path: str):
    """Holds a lock file while a run writes; another run that wants it fails at once."""
    with open(path, "w") as held:
        try:
            fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError(f"another run holds {path}") from None
        yield


def progress(done: int, total: int, seconds: float) -> str:
    """What is done of a run, and how long the rest takes at this pace."""
    rest = f"{seconds / done * (total - done):.0f} s left" if done else "no pace yet"
    return f"{done}/{total} ({done / total:.0%}), {rest}" if total else "0/0"


def memory_megabytes() -> dict[str, float | None]:
    """Resident memory of this process and memory of the machine, from /proc; null elsewhere."""

    def read(path: str, name: str) -> float | None:
        try:
            with open(path) as f:
                return next((int(line.split()[1]) / 1024 for line in f if line.startswith(name)), None)
        except OSError:
            return None

    return {"resident": read("/proc/self/status", "VmRSS:"), "total": read("/proc/meminfo", "MemTotal:"), "available": read("/proc/meminfo", "MemAvailable:")}
