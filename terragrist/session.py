"""Spark sessions sized to the machine or container they start on."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Resources:
    """What a session may use: cores, bytes of memory, bytes of scratch disk."""

    cpus: int
    memory: int
    scratch: int

    @classmethod
    def detect(cls, scratch_dir: str = "/tmp", group: str = "/sys/fs/cgroup") -> Resources:
        """The smaller of host and container limits; scratch is half of the free disk, 1 to 64 GiB."""
        cpus = len(os.sched_getaffinity(0))
        memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        quota = _words(f"{group}/cpu.max")
        if len(quota) == 2 and quota[0].isdigit() and int(quota[1]):
            cpus = max(1, min(cpus, int(quota[0]) // int(quota[1])))
        limit = _words(f"{group}/memory.max")
        if limit and limit[0].isdigit():
            memory = min(memory, int(limit[0]))
        free = shutil.disk_usage(scratch_dir).free
        return cls(cpus, memory, min(64 << 30, max(1 << 30, free // 2)))

    def threads(self, per_thread: int = 5 << 29) -> int:
        """Threads such that each has 2.5 GiB of 60 % of the memory."""
        return max(1, min(self.cpus, int(self.memory * 0.6) // per_thread))


def _words(path: str) -> list[str]:
    try:
        return Path(path).read_text().split()
    except OSError:
        return []


def local_session(app: str = "terragrist", resources: Resources | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and string partition values; `conf` adds settings, with _ for dots."""
    r = resources or Resources.detect()
    builder = SparkSession.builder.appName(app).master(f"local[{r.threads()}]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        "spark.driver.memory": f"{max(1, int(r.memory * 0.6) >> 30)}g",
        "spark.sql.shuffle.partitions": str(4 * r.cpus),
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
