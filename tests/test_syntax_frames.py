"""A batch of many files is handed on in small frames."""

import pandas as pd

from tessera.sources.syntax import HELD, syntax_frames, syntax_rows


def test_frames_are_bounded_whatever_a_batch_holds():
    content = "import a\n\ndef f(x):\n    y = a.g(x)\n    return y\n" * 8
    files = pd.DataFrame({"path": [f"/r/src/m{k}.py" for k in range(1_500)], "content": [content] * 1_499 + ["def ("]})
    one = len(syntax_rows("/r/src/m.py", content))
    frames = list(syntax_frames(iter([files, files.iloc[:0], files.iloc[-1:]])))
    assert max(map(len, frames)) < HELD + one and sum(map(len, frames)) == 1_499 * one > 5 * HELD
    whole = pd.concat(frames)
    assert whole["path"].nunique() == 1_499 and whole["line"].notna().all() and set(whole["what"]) == {"import", "function", "bind", "set", "call"}
