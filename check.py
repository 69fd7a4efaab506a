"""Compare registered queries with their oracles: python check.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import sys
import time

from codecorpus.plans.compare import check_all

if __name__ == "__main__":
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    start = time.time()
    failed = check_all(sf_dir, args[1:])
    print(f"{len(failed)} failed in {time.time() - start:.0f}s: {failed}")
    sys.exit(bool(failed))
