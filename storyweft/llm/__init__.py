"""Training-data operators: each module holds one operator, its query and its tests' reference points.

Nothing outside this subpackage imports it. Modules follow one convention: a null text counts
as the empty text, repeated rows stay repeated unless the operator says otherwise, and only the
named id and text columns are read, so extra columns cannot clash.
"""
