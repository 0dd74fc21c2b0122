"""Stand-ins for models; a module of their own so that workers can import them."""

from __future__ import annotations


def echo():
    return lambda prompts: [f"```cpp\n{prompt}\n```" for prompt in prompts]


def batch_sizes():
    """Answers with the size of the batch a prompt came in."""
    return lambda prompts: [str(len(prompts)) for _ in prompts]


def pairs_of_answers():
    return lambda prompts: [[f"```\n{prompt}\n```", "none"] for prompt in prompts]


class Noting:
    """Answers like `echo`, notes each prompt in a file, and fails at one of them."""

    def __init__(self, log, failing=None):
        self.log, self.failing = log, failing

    def __call__(self):
        def answer(prompts):
            with open(self.log, "a") as file:
                file.writelines(f"{prompt}\n" for prompt in prompts)
            if self.failing in prompts:
                raise RuntimeError("model is down")
            return [f"```cpp\n{prompt}\n```" for prompt in prompts]

        return answer


def down():
    def fail(prompts):
        raise RuntimeError("model is down")

    return fail
