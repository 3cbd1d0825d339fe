"""Operators: hash generators (H1-H6), similarity joins (J3, J5), ranking (O1, O2),
signature store and inventory (S4-S7, J1, J2, U1, U2), counters and reports (A1, A2, S8)."""
