import re
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_only_the_entry_and_the_pipeline_name_the_training_data_operators():
    for path in [*ROOT.glob("*.py"), *(ROOT / "pagelode").rglob("*.py")]:
        if "llm" in path.relative_to(ROOT).parts or path.name in ("__spark_entry__.py", "corpus_pipeline.py"):
            continue
        assert not re.search(r"\bllm\b.*import|import.*\bllm\b", path.read_text()), path
