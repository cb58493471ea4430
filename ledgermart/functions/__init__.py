"""Column expressions shared by marts, derivations and checks."""
