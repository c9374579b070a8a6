"""Statistics of a JSON Lines file from the command line: ``python -m assize.cli --input cases.jsonl --output stats.json``."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession

from assize.operators import statistics as A
from assize.operators.corpus import Corpus
from assize.sources import jsonl, sinks

CANDIDATES = ["data/cases.jsonl", "cases.jsonl"]


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", help="JSON Lines; else ASSIZE_DATA_FILE or a file at a usual place")
    p.add_argument("--output", default="stats.json")
    p.add_argument("--export-data", help="where a copy of the input goes, as it is")
    p.add_argument("--sample-output", help="folder for the first records")
    p.add_argument("--sample-size", type=int, default=50)
    p.add_argument("--report", action="store_true", help="print sections and cases that lack one")
    return p.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    path = args.input or jsonl.resolve(CANDIDATES)
    records, counts = jsonl.read_tolerant(spark, path)
    corpus = Corpus.from_records(jsonl.require_rows(records))
    raw = records.withColumnRenamed("non-violation", "non_violation")
    payload = A.payload(corpus, raw, path, datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"))
    payload["summary"]["invalid_lines"] = counts.first().invalid
    sinks.write_payload(payload, args.output)
    if args.export_data:
        sinks.copy_input(spark, path, args.export_data)
    if args.sample_output:
        sinks.write_sample(records, args.sample_output, args.sample_size, "line_order")
    if args.report:
        sinks.section_report(corpus.paragraphs).show(50, False)
        A.section_pivot(corpus, ["admissibility", "merits", "just_satisfaction", "operative_part", "separate_opinion"]).orderBy("case_ord").show(10)
        for section in ("admissibility", "merits", "just_satisfaction"):
            print(section, "missing in", A.cases_missing(corpus, section).count())
    return payload


if __name__ == "__main__":
    run(SparkSession.builder.appName("assize").getOrCreate(), arguments())
