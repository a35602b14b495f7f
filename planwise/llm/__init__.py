"""Operators for preparing training corpora; nothing else in planwise imports this subpackage."""
