"""Lines whose notices stand behind any number of blanks."""

import duckdb
import pandas as pd

from lumirel.llm import queries, quality_rules

WORDS = " ".join(f"word{i}" for i in range(30))


def test_notices_behind_blanks_are_found_as_in_sql(spark):
    notices = ["Licensed under the MIT license", "copyright 2020 by us", "cookie policy of this site", "(c) 2020", "please enable javascript", "coo\u212aie policy", "licen\u017fed under"]
    others = ["copyrighted works", "(c)", "(c)x", "\vcopyright 2020", "terms of trade", "see our privacy policy"]
    lines = [" " * n + x for n in (0, 171, 185, 190, 191, 192, 195, 199, 200, 201, 5000) for x in notices + others] + ["\t" * 250 + "Privacy policy\t" + "x" * 500]
    # At a cut of 200 bytes 'copyrighted' ended as 'copyright' and became a notice.
    docs = pd.DataFrame({"doc_id": range(len(lines)), "text": [WORDS + "\n" + x for x in lines]})
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.sql(queries.OP3_SQL).df().set_index("doc_id").sort_index()
    rules = quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string"))
    got = rules.toPandas().set_index("doc_id").sort_index()[list(want.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert want.n_lines_removed.sum() == 11 * len(notices) + 1
