"""Operators on spans, service graphs and traces. All are lazy DataFrame plans."""
