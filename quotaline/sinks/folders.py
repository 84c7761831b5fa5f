"""Folders on any file system that Spark reads: listing, swapping, and versions that are published by one small file."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

VERSIONS = "_versions"
#: Folders of versions that were never published go once they are so old (seconds): until then a refresh may be writing them.
LEASE = 24 * 3600


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _at(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def ensure(spark: SparkSession, path: str) -> None:
    """Create a folder if it is missing."""
    fs, at = _fs(spark, path)
    fs.mkdirs(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, hidden entries left out; nothing if it is missing."""
    fs, at = _fs(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def marks(spark: SparkSession, path: str) -> dict[str, str]:
    """The files of a folder by name, each with a mark of its name, length and time; hidden ones are left out."""
    fs, at = _fs(spark, path)
    found = {}
    for f in fs.listStatus(at) if fs.exists(at) else []:
        name = f.getPath().getName()
        if f.isFile() and not name.startswith((".", "_")):
            found[name] = hashlib.blake2b(f"{name} {f.getLen()} {f.getModificationTime()}".encode(), digest_size=8).hexdigest()
    return found


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder; 0 if it is missing."""
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; fails if the target is there."""
    fs, at = _fs(spark, target)
    if fs.exists(at) or not fs.rename(_at(spark, source), at):
        raise FileExistsError(f"{source} can't become {target}")


def beside(path: str) -> str:
    """A name for a new folder next to a table's, hidden from readers of their parent."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_new-{name}-{uuid.uuid4().hex}"


def swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """Put a complete staged folder in a table's place; the old one is moved aside, and goes when the new one is in.

    Two renames: for that moment readers find no table, and a crash then leaves the old one complete beside it, hidden.
    Tables that are read all the time are published as versions instead.
    """
    aside = None
    if exists(spark, path):
        aside = beside(path).replace("/_new-", "/_old-")
        move(spark, path, aside)
    move(spark, staged, path)
    if aside:
        remove(spark, aside)


def read(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def published(spark: SparkSession, root: str) -> dict | None:
    """What the newest published version of a root says, or None."""
    numbers = [int(n) for n in names(spark, f"{root}/{VERSIONS}") if n.isdigit()]
    return json.loads(read(spark, f"{root}/{VERSIONS}/{max(numbers)}")) if numbers else None


def claim(spark: SparkSession, source: str, target: str) -> None:
    """Give a complete file its final name; of several writers of one name only one succeeds.

    On a local file system by a hard link, elsewhere by a rename that never replaces: HDFS does either as one step.
    Object stores rename by copying and are not supported for published tables.
    """
    fs, at = _fs(spark, target)
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            to_path = lambda p: jvm.java.io.File(_at(spark, p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(to_path(target), to_path(source))
            fs.delete(_at(spark, source), False)
        else:
            never = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = never
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(_at(spark, source), at, options)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            fs.delete(_at(spark, source), False)
            raise FileExistsError(f"{target} was written by another") from e
        raise


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that none was before; of several writers one succeeds, and readers see it complete."""
    parent, _, name = path.rpartition("/")
    ensure(spark, parent)
    draft = f"{parent}/_draft-{name}-{uuid.uuid4().hex}"
    _write(spark, draft, text)
    claim(spark, draft, path)


def publish(spark: SparkSession, root: str, state: dict, after: int | None = None) -> dict:
    """Make ``state`` the newest version, in one step; of two writers of the same number one fails and changes nothing.

    ``after`` is the number of the version that the state was made from: if another was published meanwhile, this fails.
    """
    newest = (published(spark, root) or {}).get("number", -1)
    state = state | {"number": (newest if after is None else after) + 1}
    write_once(spark, f"{root}/{VERSIONS}/{state['number']}", json.dumps(state))
    return state


def _folders(state: dict) -> set[str]:
    """The version folders that a state names."""

    def paths(part) -> Iterable[str]:
        for name, value in part.items() if isinstance(part, dict) else ((None, v) for v in part):
            if name == "path":
                yield value
            elif isinstance(value, (dict, list)):
                yield from paths(value)

    return {p.split("/")[0] for layer in ("tables", "states") for p in paths(state.get(layer, {}))}


def sweep(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove the folders of versions that none of the last ``keep`` published states names.

    Readers of older versions lose their files: keep as many as the longest read spans. Folders that no state ever
    named belong to a refresh that failed or still runs, and go when they are older than ``LEASE``.
    """
    numbers = sorted(int(n) for n in names(spark, f"{root}/{VERSIONS}") if n.isdigit())
    states = {n: json.loads(read(spark, f"{root}/{VERSIONS}/{n}")) for n in numbers}
    live = {f for n in numbers[-keep:] for f in _folders(states[n])}
    once = {f for n in numbers[:-keep] for f in _folders(states[n])}
    fs, at = _fs(spark, root)
    for name in names(spark, root):
        if name.startswith("version-") and name not in live:
            age = time.time() - fs.getFileStatus(_at(spark, f"{root}/{name}")).getModificationTime() / 1000
            if name in once or age > LEASE:
                remove(spark, f"{root}/{name}")
    for n in numbers[:-keep]:
        remove(spark, f"{root}/{VERSIONS}/{n}")
