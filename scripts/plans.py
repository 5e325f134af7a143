"""Print the physical plan tree of the headline queries (for docs/PLANS.md).

usage: python scripts/plans.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecfactor.plans import catalog  # noqa: E402
from vecfactor.session import build_session  # noqa: E402

NAMES = ["word_center", "known_counts", "nearest_word", "uploads_validate", "ratings_flatten",
         "predict_pairs", "features_long"]


def tree(df) -> str:
    jplan = df._jdf.queryExecution().executedPlan()
    text = jplan.toString()
    # literal sets (stop words, punctuation incl. newline characters) are elided
    text = re.sub(r"INSET .*?(?= AND | OR |\)\)|\) AND)", "INSET (...)", text, flags=re.S)
    text = re.sub(r"trim\(([^,]+), Some\(.*?\)\)", r"btrim(\1, ' \\n')", text, flags=re.S)
    return "\n".join(line[:180] for line in text.split("\n"))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(cores=8)
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `scripts/plans.py` on `{sf_dir}` (AQE initial plans; lines cut at 180 chars,")
    print("long literal lists elided).\n")
    for name in NAMES:
        df = catalog.QUERIES[name](spark, sf_dir)
        print(f"## {name}\n\n```\n{tree(df)}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
