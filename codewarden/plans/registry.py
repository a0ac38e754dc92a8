"""Named jobs over a files table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from codewarden.config import ScanConfig
from codewarden.plans.project import scan_files, scan_project

Job = Callable[[DataFrame, ScanConfig], DataFrame]


@dataclass
class Result:
    success: bool
    output: DataFrame | None = None
    errors: list[str] = field(default_factory=list)


class Registry:
    """Jobs by name; an error becomes a result.

    Tables are computed when they are written, so a job's errors at run time
    are caught where its output goes to a ``sink``.
    """

    def __init__(self) -> None:
        self._jobs: dict[str, Job] = {}

    def register(self, name: str, job: Job) -> None:
        self._jobs[name] = job

    def has(self, name: str) -> bool:
        return name in self._jobs

    def names(self) -> list[str]:
        return list(self._jobs)

    def execute(self, name: str, files: DataFrame, config: ScanConfig = ScanConfig(),
                sink: Callable[[DataFrame], None] | None = None) -> Result:
        job = self._jobs.get(name)
        if job is None:
            return Result(False, errors=[f"No such job: {name}"])
        try:
            output = job(files, config)
            if sink is not None:
                sink(output)
            return Result(True, output)
        except Exception as error:  # noqa: BLE001 - the caller gets the message
            return Result(False, errors=[str(error)])


def default_registry() -> Registry:
    registry = Registry()
    registry.register("scan-file", lambda files, config: scan_files(files, config).findings)
    registry.register("scan-project", lambda files, config: scan_project(files, config).summary())
    registry.register("generate-report", lambda files, config: scan_project(files, config).report())
    return registry
