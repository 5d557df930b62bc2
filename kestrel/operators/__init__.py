"""Operator library: each module holds DataFrame -> DataFrame functions of one family."""
