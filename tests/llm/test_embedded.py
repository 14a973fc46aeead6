"""Text of formulas, drawings and objects within a page."""

import pytest

from gridspark.llm import html_text


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"),
        ("<svg viewBox='0 0 1 1'><title>a curve</title><text>rising</text><path d='M0'/></svg>", "a curverising"),
        ("<object data='f.pdf'>the file as text</object>", "the file as text"),
        ("<script>x < 1</script><style>p {}</style><template>no</template>", ""),
        ("<svg><style>p {}</style></svg>", ""),
    ],
)
def test_text_inside_a_paragraph(inside, text):
    got = html_text.blocks(f"<html><body><article><p>before {inside} after</p></article></body></html>")
    assert [b.text for b in got] == [" ".join(f"before {text} after".split())]
    assert "t:p" in got[0].features
