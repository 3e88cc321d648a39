"""Files by path or address: mounted folders, and any store that Arrow's file systems know (hdfs://, s3://, gs://, file://)."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from pathlib import Path

_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:/")


def local(path: str) -> str:
    """file:/a and file:///a as /a."""
    return re.sub(r"^file:/+", "/", path)


def _at(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


def shared_folder(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def application_folder(spark) -> str:
    """A folder of this application in the shared one; it is deleted when the application ends."""
    sc = spark.sparkContext
    folder = getattr(sc, "_larkspur_files", None)
    if folder is None:
        folder = f"{shared_folder(spark)}/larkspur-files-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(sc._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        sc._larkspur_files = folder
    return folder


def write_bytes(path: str, content: bytes) -> None:
    path = local(path)
    if _ADDRESS.match(path):
        store, place = _at(path)
        with store.open_output_stream(place) as f:
            f.write(content)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(content)


def names(folder: str) -> list[str]:
    """The names in a folder, in order."""
    folder = local(folder)
    if not _ADDRESS.match(folder):
        return sorted(p.name for p in Path(folder).iterdir())
    from pyarrow import fs

    store, path = _at(folder)
    return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(path)))


def find_file(folder: str, table: str, ending: str) -> str:
    """The file of a table, its name without regard to case."""
    wanted = (table + ending).lower()
    found = next((n for n in names(folder) if n.lower() == wanted), None)
    if found is None:
        raise FileNotFoundError(f"{folder} has no {table}{ending}")
    return f"{folder.rstrip('/')}/{found}"


class Source:
    """Parts of a file, or of bytes at hand."""

    def __init__(self, content: bytes | str):
        self._file = None
        if isinstance(content, (bytes, bytearray, memoryview)):
            self._held = memoryview(content)
            self.size = len(self._held)
            return
        content = local(content)
        if _ADDRESS.match(content):
            store, path = _at(content)
            self._file = store.open_input_file(path)
            self.size = self._file.size()
        else:
            self._file = open(content, "rb")  # noqa: SIM115  closed with the object
            self.size = Path(content).stat().st_size

    def read(self, at: int, n: int) -> bytes:
        """n bytes from a place on, fewer at the end."""
        if self._file is None:
            return bytes(self._held[at : at + n])
        self._file.seek(at)
        return self._file.read(n)

    def __del__(self) -> None:
        if self._file is not None:
            self._file.close()


def read_text(path: str) -> str:
    source = Source(path)
    return source.read(0, source.size).decode("utf-8")
