"""Row order and names: what verbs need before a plan is built."""
