"""Reading and writing what lies outside the plan."""
