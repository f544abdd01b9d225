"""Values beside a time of day or a full stop."""

from evalweave.llm import pii


def test_values_after_stops_and_before_times(spark):
    dated = "2024-03-05T10:00:00Z end.2024-03-05 on 05.03.2024T10:00 call.212-555-0199"
    left = "1.2024-03-05 2024-03-05x 2024-03-05Tx 123-45-6789T1 a2024-03-05"
    mail = "jo.2024-03-05@mail.example.org"
    rows = [(1, dated), (2, left), (3, mail)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_values == 4 and "2024-03-05" not in by_id[1].text and "T10:00:00Z end." in by_id[1].text
    assert by_id[2].text == left and by_id[3].n_values == 1
    restored = pii.pseudonymise(spark.createDataFrame(got), "key", undo=True).collect()
    assert {r.text for r in restored} == {t for _, t in rows}
