"""Arriving packets are reviewed once each."""

import json

from chalkline.streaming.intake import ingest
from tests.test_review import BODY, changed, packet


def test_arriving_packets(spark, tmp_path):
    for folder in ("in", "out"):
        (tmp_path / folder).mkdir()
    files = [changed("src/app/ledger.py", "@@ -1 +1 @@\n-total = 0\n+LedgerTotals = exact(total)")]

    def run():
        query = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
        query.awaitTermination()

    (tmp_path / "in" / "1.json").write_text(json.dumps(packet(1, BODY, None, files)))
    (tmp_path / "in" / "2.json").write_text("{}")
    run()
    (tmp_path / "in" / "3.json").write_text(json.dumps(packet(3, BODY, None, files)))
    run()
    run()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert sorted(r.review_id for r in read("facts").collect()) == ["o/r#1", "o/r#3"]
    assert {r.batch for r in read("selections").collect()} == {0, 1}
    assert [r.refusal for r in read("refused").collect()] == ["unreadable"]
