"""Memory of the Python tasks of the pipeline."""

import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from warehaul.llm import similar


class Plan:
    """Stands for a DataFrame and keeps the partition function."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_postings_of_a_batch_are_sorted_range_by_range():
    rng, n, parts = np.random.default_rng(1), 10_000, 51
    prints = rng.integers(0, 256, (n, 128), np.uint8)
    prints[100:300] = prints[100]
    nums = np.arange(n)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(nums), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array(np.full(n, 50))], ["num", "fp", "n"]
    )
    plan, places = Plan(), similar._places(1024, 6, 3)
    similar._postings(plan, places, 0.8, parts, 64)
    tracemalloc.start()
    rows = [r for b in plan.run(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    # every text has each of its keys once, but for the hot ones, of which one member goes to the part
    plain, hot = ([r for r in rows if (r["part"] >= parts) == is_hot] for is_hot in (False, True))
    assert len(hot) == len(places) and all(len(r["members"]) == 400 for r in hot)
    assert len({r["part"] for r in plain}) == len(plain) == parts
    assert sum(len(r["sizes"]) for r in plain) == len(places) * (n - 199)


_FREED = """
import pyarrow as pa
from warehaul.llm.common import released

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096

def task(batches):
    held = [bytes(1000) for _ in range(200_000)]
    kept.append(bytes(1000))
    yield from batches

kept, before = [], resident()
list(released(task)(iter([])))
print(resident() - before)
"""


def test_a_worker_does_not_keep_what_a_task_has_freed():
    found = subprocess.run([sys.executable, "-c", _FREED], capture_output=True, text=True, check=True)
    assert int(found.stdout.split()[-1]) < 60e6
