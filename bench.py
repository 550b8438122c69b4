"""Headline queries at one scale; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (threads).
"""

from __future__ import annotations

import json
import os
import sys
import time

from threadloom import session
from threadloom.plans.catalog import QUERIES

HEADLINE = (
    "validate_message", "dead_letter", "conversation_state", "conversation_final",
    "attach_summary_asof", "sentiment_context", "context_last5", "transcript", "detect_pii",
    "detect_pii_documents", "pii_counts", "validate_agent_result", "parse_model_response",
    "merge_intelligence", "merge_intelligence_final", "latest_summary", "intelligence_lookup",
    "qa_metrics", "intent_urgency_report", "trailing_rate", "summary_fold", "score",
    "stream_latest_summary", "stream_conversation_state", "stream_merge_intelligence",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session("bench", f"local[{cpus}]", cpus, **{"spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query, so the first one does not pay for the start of the JVM.
    QUERIES["message_ordinal"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds, first, failed = {}, {}, {}
    for name in sys.argv[1:] or HEADLINE:
        try:
            # The first run pays for code generation and the JIT; the second one is warm.
            for runs in (first, seconds):
                start = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                runs[name] = round(time.perf_counter() - start, 3)
        except Exception as problem:  # a broken query must not hide the others
            failed[name] = str(problem).splitlines()[0][:200]
    result = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
              "unit": "sec", "queries": seconds, "first_run": first,
              "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf")}
    if failed:
        result["failed"] = failed
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
