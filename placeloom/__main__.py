"""python -m placeloom: see cli.py."""

from .cli import main

main()
