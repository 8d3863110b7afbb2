"""Aviation text reports to structs, by built-in expressions.

The sections of a report come in a fixed order and each is optional, so one anchored expression
takes a report apart: what it leaves over is what a reader stops at. A report that cannot be read
keeps its row, with the reason in `error`.
"""
