"""Templates of pages that nest deeper than Python's stack."""

from marketflow.llm.wrapper import Template


def test_deep_skeletons_align():
    deep = [(-1, "html", "")] + [(i, "div", "") for i in range(3000)]
    template = Template()
    first = template.align([*deep, (3000, "p", "")])
    assert template.align([*deep, (3000, "p", ""), (3000, "ul", "")])[:3002] == first
