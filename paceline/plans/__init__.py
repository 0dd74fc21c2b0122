"""Registered queries: input views, the operator calls on them, and the SQL each must agree with."""
