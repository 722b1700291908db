"""Immutable snapshots with metadata, bounded HTTP reads, and atomic publication of results."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import time
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import endpoint_slug

def snapshot_name(endpoint: str, taken: datetime) -> str:
    return f"{endpoint_slug(endpoint)}__{taken.astimezone(UTC):%Y%m%dT%H%M%SZ}.json"


def write_snapshot(root: str | Path, season: str, endpoint: str, content: bytes, source: str, taken: datetime | None = None, **more: object) -> Path:
    """Writes the bytes and a metadata file beside them; a snapshot that is there already is an error."""
    taken = taken or datetime.now(UTC)
    path = Path(root) / season / snapshot_name(endpoint, taken)
    path.parent.mkdir(parents=True, exist_ok=True)
    meta = {"source": source, "season": season, "endpoint_name": endpoint, "retrieved_at": taken.astimezone(UTC).isoformat(), "sha256": hashlib.sha256(content).hexdigest(), "content_length": len(content), "raw_path": path.name, **more}
    with path.open("xb") as f:
        f.write(content)
    path.with_suffix(".meta.txt").write_text(json.dumps(meta, indent=1, sort_keys=True))
    return path


def read_metadata(path: Path) -> dict:
    """The metadata of a snapshot, once its bytes still have the recorded digest."""
    meta = json.loads(Path(path).with_suffix(".meta.txt").read_text())
    if hashlib.sha256(Path(path).read_bytes()).hexdigest() != meta["sha256"]:
        raise ValueError(f"snapshot changed: {path}")
    return meta


def fetch(url: str, retries: int = 3, wait: float = 0.5, opener: Callable[[str], bytes] | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """GET with a bounded number of tries and doubling waits."""
    opener = opener or (lambda u: urllib.request.urlopen(u, timeout=30).read())  # noqa: S310
    for attempt in range(retries):
        try:
            return opener(url)
        except OSError:
            if attempt == retries - 1:
                raise
            sleep(wait * 2**attempt)
    raise AssertionError


def cached_fetch(root: str | Path, season: str, endpoint: str, url: str, offline: bool = False, refresh: bool = False, **options) -> Path:
    """The latest snapshot of an endpoint; fetched if there is none or a refresh is asked for, never offline."""
    have = sorted((Path(root) / season).glob(f"{endpoint_slug(endpoint)}__*.json"))
    if have and not refresh:
        return have[-1]
    if offline:
        raise FileNotFoundError(f"no snapshot of {endpoint} for {season}")
    return write_snapshot(root, season, endpoint, fetch(url, **options), url)


def require_fields(payload: dict | list, fields: dict[str, type]) -> None:
    """The top level of a document has these fields of these types."""
    if not isinstance(payload, dict):
        raise TypeError("the document is no object")
    wrong = [n for n, kind in fields.items() if not isinstance(payload.get(n), kind)]
    if wrong:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}")


def table_fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows whatever their order and partitions; one aggregate row reaches the driver."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    g = F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)), F.sum(h), F.sum(g)).first()
    return hashlib.sha256(repr((sorted(df.dtypes), tuple(map(str, row)))).encode()).hexdigest()


def resolve_revision(url: str, read: Callable[[str], bytes] = fetch) -> str:
    """The commit that a branch stands at, as a hosting service's branch document tells it."""
    try:
        revision = json.loads(read(url))["commit"]["sha"]
    except (KeyError, TypeError, ValueError) as wrong:
        raise ValueError(f"no revision in {url}") from wrong
    if not isinstance(revision, str) or not revision:
        raise ValueError(f"no revision in {url}")
    return revision


def pinned_url(base: str, revision: str, season: str, path: str) -> str:
    """Where a season's file stands at one revision."""
    return "/".join([base.rstrip("/"), revision, "data", season, path.lstrip("/")])


def take_pinned(root: str | Path, base: str, revision: str, season: str, path: str, read: Callable[[str], bytes] = fetch) -> Path:
    """A snapshot of a season's file at one revision; the revision goes into the metadata."""
    source = pinned_url(base, revision, season, path)
    return write_snapshot(root, season, path, read(source), source, revision=revision)


@contextlib.contextmanager
def single_writer(path: str | Path) -> Iterator[None]:
    """A lock file that only one writer can create; gone when the writer is done."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x") as f:
        f.write(str(os.getpid()))
    try:
        yield
    finally:
        path.unlink(missing_ok=True)


def publish(root: str | Path, run_id: str, build: Callable[[Path], dict], fingerprint: str | None = None) -> dict:
    """Builds a run in a hidden folder, moves it into place and then swaps the pointer, each step atomic.

    The same fingerprint as the last success is no change. If building fails, the folder goes to
    ``failed``, the pointer stays on the last good run and the error is raised.
    """
    root = Path(root)
    pointer = root / "latest.json"
    last = json.loads(pointer.read_text()) if pointer.exists() else None
    if fingerprint and last and last.get("fingerprint") == fingerprint:
        return last | {"state": "NO_CHANGE"}
    with single_writer(root / "publish.lock"):
        hidden = root / f".{run_id}.tmp"
        hidden.mkdir(parents=True)
        try:
            manifest = build(hidden)
            files = {p.relative_to(hidden).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(hidden.rglob("*")) if p.is_file()}
            manifest = {**manifest, "run_id": run_id, "fingerprint": fingerprint, "files": files, "state": "PUBLISHED"}
            (hidden / "manifest.json").write_text(json.dumps(manifest, indent=1, sort_keys=True))
            target = root / "runs" / run_id
            target.parent.mkdir(exist_ok=True)
            if target.exists():
                raise FileExistsError(target)
            hidden.rename(target)
        except BaseException:
            failed = root / "failed" / run_id
            failed.parent.mkdir(exist_ok=True)
            shutil.rmtree(failed, ignore_errors=True)
            if hidden.exists():
                hidden.rename(failed)
            raise
        swap = root / ".latest.json.tmp"
        swap.write_text(json.dumps(manifest, indent=1, sort_keys=True))
        swap.replace(pointer)
    return manifest


def verify_run(folder: str | Path) -> list[str]:
    """Files of a run that are missing or no longer have the digest of the manifest."""
    folder = Path(folder)
    files = json.loads((folder / "manifest.json").read_text())["files"]
    return sorted(n for n, digest in files.items() if not (folder / n).exists() or hashlib.sha256((folder / n).read_bytes()).hexdigest() != digest)
