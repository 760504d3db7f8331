"""What workers keep between the stages of a pipeline."""

import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest

_RUN = """
import ctypes, random, re, sys
import pyarrow as pa
from rulefold.llm.tokens import Encoder

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

draw = random.Random(7)
word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9)))
encoder = Encoder.of(open(sys.argv[1], encoding="utf-8").read())
for _ in range(4):
    for ids, offsets in encoder.slices(pa.array([" ".join(word() for _ in range(500)) for _ in range(800)])):
        pass
ids = offsets = None
before = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(before - held())
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory cannot be read here")
def test_an_encoder_gives_back_what_it_has_freed():
    root = Path(__file__).resolve().parents[2]
    run = subprocess.run([sys.executable, "-c", _RUN, public_tokenizers.path("word_bpe_49k.json")], cwd=root, capture_output=True, text=True, timeout=120, check=True)
    assert float(run.stdout.split()[-1]) < 15
