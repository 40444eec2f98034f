"""Write docs/plans.md: the physical plans (operator tree + scan details) of
the key queries, as produced by ``explain("formatted")`` at sf0.01."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEY = ["classify_logs", "session_prompt", "session_split", "hybrid_scores", "lexical_scores", "chunk_documents",
       "summarise_documents", "email_headers", "thread_findings", "thread_fold", "html_tables", "import_edges"]


def main(sf="/root/testdata/sf0.01", out="docs/plans.md"):
    from loglens.config import local_session
    from loglens.plans import catalog

    spark = local_session(8)
    parts = ["# Physical plans of key queries\n",
             "Generated by `scripts/dump_plans.py` (`explain('formatted')`, sf0.01, local[8], AQE initial plan). "
             "Only the operator tree and each scan's `ReadSchema` / `PushedFilters` are kept.\n"]
    for name in KEY:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            catalog.QUERIES[name](spark, sf).explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n\n")[0]
        details = [ln for ln in text.splitlines() if ln.startswith(("PushedFilters", "ReadSchema", "Location"))]
        details = [re.sub(r"\[file:[^\]]*/", "[", d) for d in details]
        parts.append(f"## {name}\n\n```\n{tree.strip()}\n\n" + "\n".join(details) + "\n```\n")
    with open(out, "w") as f:
        f.write("\n".join(parts))


if __name__ == "__main__":
    main()
