"""Print the formatted physical plans of the headline stages (scan pruning,
pushed filters, broadcast joins, shuffles) at a small scale factor.

usage: python scripts/explain_plans.py [sf_dir] > plans.txt
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailsift.operators import classify as CL  # noqa: E402
from mailsift.operators import corpus as C  # noqa: E402
from mailsift.operators import metrics as MT  # noqa: E402
from mailsift.plans.pipeline import TextRun, materialise  # noqa: E402
from mailsift.session import local_session  # noqa: E402
from mailsift.sources import tables as S  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8)
    raw = S.corpus_view(spark, sf_dir)
    stages = {"corpus (clean + dedupe)": C.build_corpus(raw)}
    run = TextRun(spark, materialise(C.build_corpus(raw)))
    stages["split membership"] = run.parts
    stages["term counts (per document, in-row)"] = run.terms
    stages["features (TF-IDF, map-only)"] = run.features
    stages["NB hold-out report"] = MT.classification_report(run.scored(run.nb))
    stages["classify messages"] = CL.classify_messages(run.tfidf, run.nb, S.mail_view(spark, sf_dir),
                                                       CL.trusted_domains(S.trusted_view(spark, sf_dir)))
    for name, df in stages.items():
        print("=" * 100)
        print(name)
        print("=" * 100)
        df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
