"""The bounded word cache of the token store."""

import os
import subprocess
import sys

from plateau.llm import token_store
from plateau.llm.token_store import Encoder, default_tokenizer


def test_a_small_cache_changes_no_ids():
    texts = [" ".join(f"word{i * k} Ünïcode{i}," for i in range(40)) for k in range(1, 30)]
    want = Encoder.get(default_tokenizer()).batch(texts)
    full = len(Encoder.get(default_tokenizer()).cache)
    for bound in (0, 7, 500):
        encoder = Encoder.get(default_tokenizer(), cache_words=bound)
        assert [encoder.batch([t])[0] for t in texts] == want
        assert len(encoder.cache) <= bound < full


def test_a_worker_encodes_in_its_own_thread():
    code = """
import os
from plateau.llm.token_store import Encoder, default_tokenizer
threads = lambda: len(os.listdir("/proc/self/task"))
encoder = Encoder(default_tokenizer())
before = threads()
encoder.batch([" ".join(f"word{i * k}x" for i in range(500)) for k in range(1, 40)])
print(threads() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(token_store.__file__)))
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True, timeout=120)
    assert done.stdout.split()[-1] == "0"
