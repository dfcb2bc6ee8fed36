"""Events come in batches of bounded size, and are the same however a document is sliced."""

import pytest
from test_documents import LONG, batches

from xylem.streaming import sax


def test_batches_of_events_are_bounded():
    for texts in ([LONG], ["<r>" + "<e k='1'>t</e>" * 20 + "</r>"] * 3_000):
        events = batches(sax.sax_events, texts)
        assert max(b.num_rows for b in events) < 2 * sax.ROWS
        assert sum(b.num_rows for b in events) == sum(4 + 3 * x.count("<e ") for x in texts)


def test_events_are_taken_away_while_a_document_is_read():
    h, most, got = sax._Rows(), 0, []
    for _ in sax.steps(LONG, h):
        most = max(most, len(h.rows))
        got += h.rows
        h.rows.clear()
    got += h.rows
    whole = sax._Rows()
    sax.drive(LONG, whole)
    assert got == whole.rows and most < len(got) // 4


@pytest.mark.parametrize("length", [1, 3, 50])
def test_texts_are_not_cut_where_slices_end(length):
    xml = "<a>one two<b>three</b>f&amp;g<![CDATA[h i]]>tail<!--c-->é</a>"
    h, whole = sax._Rows(), sax._Rows()
    for _ in sax.steps(xml, h, length):
        pass
    sax.drive(xml, whole)
    assert h.rows == whole.rows
