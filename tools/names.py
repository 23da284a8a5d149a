"""Print the query names registered in the given plan modules."""
import pathlib
import re
import sys

root = pathlib.Path(__file__).resolve().parents[1] / "muonloom" / "plans"
for module in sys.argv[1:]:
    print(*re.findall(r'@query\("(\w+)"', (root / f"{module}.py").read_text()))
