"""Checked-out trees as a Spark data source that plans folders and never lists an ignored one.

A partition is a folder of a repository: its top folders each with all below them, and its own files. Ignored folders are cut off where their parent is listed, so what lies in a vendored tree is never seen."""

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed


class Folder(InputPartition):
    def __init__(self, repo_id: str, path: str, deep: bool):
        super().__init__((repo_id, path, deep))
        self.repo_id, self.path, self.deep = repo_id, path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.max_bytes = options["path"], int(options.get("maxbytes", 1 << 20))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else os.path.abspath(self.root))

    def _listed(self, files, path: str):
        """(folders, files) of one folder, without ignored folders and links."""
        from pyarrow import fs

        local = isinstance(files, fs.LocalFileSystem)
        found = [x for x in files.get_file_info(fs.FileSelector(path)) if not (local and os.path.islink(x.path))]
        folders = [x for x in found if x.type == fs.FileType.Directory and x.base_name.lower() not in fixed.IGNORED_DIRECTORIES]
        return folders, [x for x in found if x.type == fs.FileType.File]

    def partitions(self) -> list[InputPartition]:
        files, top = self._open()
        parts: list[InputPartition] = []
        for repository in self._listed(files, top)[0]:
            parts.append(Folder(repository.base_name, repository.path, False))
            parts += [Folder(repository.base_name, x.path, True) for x in self._listed(files, repository.path)[0]]
        return parts or [Folder("", "", False)]

    def read(self, partition: Folder):
        if not partition.repo_id:
            return
        files, top = self._open()
        prefix, left = len(f"{top.rstrip('/')}/{partition.repo_id}/"), [partition.path]
        while left:
            folders, found = self._listed(files, left.pop())
            left += [x.path for x in folders] if partition.deep else []
            for x in found:
                if x.size <= self.max_bytes:
                    with files.open_input_stream(x.path) as stream:
                        yield partition.repo_id, x.path[prefix:], stream.read(), x.size


class TreeSource(DataSource):
    """Options: path, a folder of repositories; maxbytes, the size of the largest file that is read (1 MB)."""

    @classmethod
    def name(cls) -> str:
        return "trees"

    def schema(self) -> str:
        return "repo_id string, path string, content binary, size_bytes long"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))
