from larkspread.cli import run

raise SystemExit(run())
