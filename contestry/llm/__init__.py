"""Operators for preparing training text: tokens, packing, scoring, and duplicate removal.

One module per operator; ``queries`` applies each to its whole table. Nothing else in the
package imports this subpackage.
"""
