from .cli import main

print(main())
