"""Maps a sequence and prints its scores per ring (SNK4): python -m terrafold ROOT SEQ [--frames N] [--start N]
[--poses gt|slam] [--out DIR]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from terrafold.api import MapSession, text_table
from terrafold.operators.evalmap import blocks, compared, reference, scores
from terrafold.sources import scans


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("root")
    a.add_argument("seq")
    a.add_argument("--schedule", default="5_10_20_40")
    a.add_argument("--frames", type=int)
    a.add_argument("--start", type=int, default=0)
    a.add_argument("--poses", choices=["gt", "slam"])
    a.add_argument("--out")
    args = a.parse_args(argv)
    spark = SparkSession.builder.appName("terrafold").getOrCreate()
    if not scans.sequence_exists(spark, args.root, args.seq):
        a.error(f"{args.root} has no sequence {args.seq}")
    p = scans.points(spark, args.root, args.seq, args.start, args.frames, args.poses)
    s = MapSession.build(p, args.schedule)
    if args.out:
        s.save(f"{args.out}/state")
    got = scores(compared(s.state, blocks(reference(p), s.schedule)), s.schedule).orderBy("ring").collect()
    print(text_table([r.asDict() for r in got]))


if __name__ == "__main__":
    main()
